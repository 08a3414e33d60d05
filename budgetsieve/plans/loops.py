"""Driver loops: rounds of scoring, choosing and labelling, for all targets at once.

A round's state (labelled items, scored items, arms) is one table each, written once a round; what is in
the pool is never collected, and every step joins on the target, so that plans don't grow with targets.
A :class:`Method` says which model scores, how partitions are explored, how a batch is acquired and how
the final list is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.functions.expr import hash_order
from budgetsieve.operators import allocation as A
from budgetsieve.operators import metrics as M
from budgetsieve.operators import ranking as R
from budgetsieve.operators import sampling as S
from budgetsieve.operators import vectors as V
from budgetsieve.plans.registry import METHODS, Method, final_scores
from budgetsieve.sources.sinks import small, written

KEYS = list(R.KEYS)
ITEM = [*KEYS, "item_id"]
PART = [*KEYS, "part_id"]


@dataclass
class Protocol:
    """Sizes of a run; the defaults are the published ones."""

    initial: int = 512
    rounds: int = 8
    query: int = 256
    reservoir_fraction: float = 0.05
    reservoir: int = 256
    selected: int = 32
    candidates: int = 4
    members: int = 5
    neighbours: int = 5
    seed: int = 0
    refresh: bool = False
    round_blend: float = 0.0
    final_blend: float = 0.0

    @classmethod
    def fitted(cls, items: int, **more) -> Protocol:
        """The published sizes, with labels and batches in proportion for targets of fewer items than 16 times the budget."""
        return cls(initial=max(32, min(512, items // 16)), query=max(16, min(256, items // 32)), **more)


def shared_pool(pool: DataFrame, labels: dict[str, Column]) -> DataFrame:
    """One pool under several labels: a target for each, so that a loop serves all of them."""
    marked = F.explode(F.array(*[F.struct(F.lit(name).alias("target"), value.cast("int").alias("label")) for name, value in labels.items()]))
    return pool.withColumn("__l", marked).select(*pool.columns, "__l.target", "__l.label")


def scored_by(method: Method, rows: DataFrame, labeled: DataFrame, p: Protocol, seed: int, doubt: bool, blend: float = 0.0) -> DataFrame:
    """Adds mu and u_epi by the method's model, fitted on each target's labels; with doubt also u_conf. blend: weight of retrieval."""
    if method.model == "knn":
        out = V.score_neighbours(rows, labeled, p.neighbours, KEYS)
    elif method.model == "extra":
        out = V.extra_tree_scores(rows, labeled, max(64, 16 * p.members), seed, KEYS)
    elif method.model == "forest":  # one fit a target: Spark grows a forest as a job of its own
        out = None
        for (target,) in labeled.select("target").distinct().orderBy("target").collect():
            part = V.forest_scores(rows.where(F.col("target") == F.lit(target)), labeled.where(F.col("target") == F.lit(target)), max(32, 16 * p.members), seed)
            out = part if out is None else out.unionByName(part)
    else:
        out = V.score_linear(rows, V.logistic_ensemble(labeled, p.members, seed, keys=KEYS), KEYS)
    if blend:
        out = V.blended(out, labeled, blend, KEYS)
    if not doubt:
        return out.withColumn("u_conf", F.lit(0.0))
    near = V.knn_mean_distance(rows, labeled, p.neighbours, "u_conf", KEYS)
    return R.joined(out, near, ITEM, "inner")


def _doubts(method: Method) -> bool:
    """Whether a batch or a partition is chosen by uncertainty."""
    return method.acquire in ("uncertainty", "legacy") or method.explore == "legacy"


def chosen_partitions(method: Method, rows: DataFrame, labeled: DataFrame, round_number: int, p: Protocol, most: int) -> DataFrame:
    """The partitions that a round looks into, from the rows scored so far."""
    pulls = labeled.groupBy(*PART).agg(F.count("*").alias("pulls"))
    if method.explore == "random":
        dice = F.md5(F.concat(F.lit(f"{p.seed}:parts:{round_number}:"), F.col("part_id").cast("string")))
        return A.select_partitions(rows.select(*PART).distinct().withColumn("utility", dice), most)
    if method.explore == "legacy":
        return A.select_partitions(A.utility_legacy(rows, pulls, round_number, method.option("u", 1.5)), most)
    return A.select_partitions(A.utility(rows, pulls, round_number, method.explore or "no_ucb", method.option("topmean", 0.05)), most)


def _batch(method: Method, rows: DataFrame, p: Protocol, round_number: int) -> DataFrame:
    scored = A.acquired(rows, method.acquire, method.option("w", 0.7), KEYS, seed=p.seed + round_number)
    return R.top_per(scored, F.col("acquisition").desc(), p.query)


def _logged(log: list[dict], round_number: int, labeled: DataFrame, **more: int) -> None:
    """Appends a row a target: labelled items and hits, and what the round cost (as many rows as targets)."""
    for r in labeled.groupBy(*KEYS).agg(F.count("*").alias("labeled"), F.sum("label").alias("hits")).orderBy(*KEYS).collect():
        log.append({"round": round_number, "target": r["target"], "labeled": r["labeled"], "hits": int(r["hits"]), **more})


def final_list(method: Method, rows: DataFrame, name: str) -> DataFrame:
    return R.ranked(final_scores(rows, name), F.col("final").desc())


def full_pool(pool: DataFrame, name: str, protocol: Protocol | None = None, final: str | None = None) -> tuple[DataFrame, list[dict]]:
    """The full-pool loop: each round scores all open items, and labels a batch of the whole pool or of chosen partitions.

    pool: target, item_id, label, alert, scaffold, part_id, x. Ranks the whole pool at the end by the method's
    final score, or by another method's (final). Returns the ranking and a log.
    """
    p, method = protocol or Protocol(), METHODS[name]
    most = max(1, min(32, p.query // 8))
    labeled = written(S.initial_labels(pool, p.initial, seed=p.seed).select(*pool.columns), "labeled")
    log: list[dict] = []
    for r in range(p.rounds):
        open_items = pool.join(labeled.select(*ITEM), ITEM, "left_anti")
        scored = scored_by(method, open_items, labeled, p, p.seed + r, _doubts(method), p.round_blend)
        if method.explore is None:
            batch = _batch(method, scored, p, r)
        else:
            scored = written(scored, "scored")
            chosen = chosen_partitions(method, scored, labeled, r, p, most)
            acquired = A.acquired(scored, method.acquire, method.option("w", 0.7), KEYS, seed=p.seed + r)
            batch = A.select_batch(acquired, chosen, p.query, F.col("acquisition"), p.seed + r)
        labeled = written(labeled.unionByName(batch.select(*pool.columns)), "labeled")
        _logged(log, r, labeled)
    rows = scored_by(METHODS[final or name], pool, labeled, p, p.seed + p.rounds, True, p.final_blend)
    return final_list(method, written(rows, "scored"), final or name), log


def run_metrics(final: DataFrame, log: list[dict], ks: Sequence[int] = (100, 500, 1000), fraction: float = 0.01) -> DataFrame:
    """A run's row a target: labelled items and hits, then hits, groups and clean share of the top, enrichment and early recognition."""
    spark = final.sparkSession
    last = {x["target"]: x for x in log}
    kind = final.schema["target"].dataType.simpleString()
    queried = spark.createDataFrame([(t, x["labeled"], x["hits"]) for t, x in last.items()], f"target {kind}, queried long, queried_hits long")
    wide = M.at_k(final, ks).groupBy(*KEYS).pivot("k", list(ks)).agg(F.first("hits").alias("hits"), F.first("recall").alias("recall"), F.first("groups").alias("groups"), F.first("alert_free").alias("alert_free"))
    return R.joined(R.joined(R.joined(queried, wide, KEYS), M.enrichment(final, fraction), KEYS), M.bedroc(final), KEYS)


def calibrated(pool: DataFrame, labeled: DataFrame, p: Protocol, alpha: float = 0.1) -> DataFrame:
    """A nested fit on the labels: one row a target with the conformal threshold and what it covers.

    A stratified share of the labelled items is held out; the ensemble is fitted again on the others, the held-out
    residuals give the threshold, and all items without a label test it.
    """
    split = written(M.stratified_split(labeled, seed=p.seed), "split")
    train, held = split.where("NOT calibration").drop("calibration"), split.where("calibration").drop("calibration")
    coefficients = written(V.logistic_ensemble(train, p.members, p.seed, keys=KEYS), "coefficients")
    thresholds = M.conformal_threshold(V.score_linear(held, coefficients, KEYS), alpha)
    test = R.joined(pool, labeled.select(*ITEM, F.lit(True).alias("__seen")), ITEM).where("__seen IS NULL").drop("__seen")
    scored = written(V.score_linear(test, coefficients, KEYS).withColumn("u_conf", F.col("u_epi")), "tested")
    sizes = split.groupBy(*KEYS).agg(F.count_if(~F.col("calibration")).alias("n_train"), F.count_if("calibration").alias("n_calibration"))
    found = scored.groupBy(*KEYS).agg(F.count("*").alias("n_test"), M.brier().alias("brier"), M.nll().alias("nll"))
    out = R.joined(sizes, found, KEYS)
    for part in (thresholds, M.conformal_coverage(scored, thresholds), M.ece(scored), M.risk_coverage(scored)):
        out = R.joined(out, part, KEYS)
    return out


def true_budget(pool: DataFrame, name: str = "true_budgeted_reliable", protocol: Protocol | None = None) -> tuple[DataFrame, list[dict]]:
    """Probes reservoirs, picks partitions, scores only their candidates, labels the best; then ranks what was scored."""
    p, method = protocol or Protocol(), METHODS[name]
    probe = lambda seed: written(S.reservoir_fraction(pool, p.reservoir_fraction, p.reservoir, seed).select(*pool.columns), "probed")
    labeled = written(S.initial_labels(pool, p.initial, seed=p.seed).select(*pool.columns), "labeled")
    probed = probe(p.seed)
    seen = labeled.select(*ITEM)
    log: list[dict] = []
    inferences = 0
    for r in range(p.rounds):
        if p.refresh and r:
            probed = probe(p.seed + r)
        reservoir = written(scored_by(method, probed, labeled, p, p.seed + r, _doubts(method)), "scored")
        chosen = small(chosen_partitions(method, reservoir, labeled, r, p, p.selected).select(*PART), "chosen")
        open_items = pool.join(labeled.select(*ITEM), ITEM, "left_anti").join(chosen.withColumn("__in", F.lit(True)), PART, "left")
        inside, others = open_items.where("__in").drop("__in"), open_items.where("__in is null").drop("__in")
        candidates = written(A.candidate_cap(inside, others, p.query, p.candidates, p.seed + r).select(*pool.columns), "candidates")
        fresh = candidates.join(reservoir.select(*ITEM), ITEM, "left_anti")
        known = reservoir.join(candidates.select(*ITEM), ITEM, "left_semi")  # scored already
        scored = written(scored_by(method, fresh, labeled, p, p.seed + r, _doubts(method)).unionByName(known), "scored")
        batch = _batch(method, scored, p, r)
        seen = written(seen.unionByName(scored.select(*ITEM)).unionByName(probed.select(*ITEM)).distinct(), "seen")
        labeled = written(labeled.unionByName(batch.select(*pool.columns)), "labeled")
        inferences += probed.count() + fresh.count()
        _logged(log, r, labeled, inferences=inferences)
    subset = pool.join(seen, ITEM, "left_semi")
    rows = written(scored_by(method, subset, labeled, p, p.seed + p.rounds, True), "scored")
    return final_list(method, rows, name), log


def arm_bandit(pool: DataFrame, name: str = "true_arm_risk_ranked", protocol: Protocol | None = None, compat: bool = False) -> tuple[DataFrame, DataFrame, list[dict]]:
    """Arms are partitions: bounds pick arms, each arm yields its best items, mean labels are the rewards.

    Each arm gives its best items up to an equal quota, and the best of the others fill the batch where arms
    are short. With ``compat`` a batch that is too large loses its largest ids instead of its lowest scores.
    Returns the final ranking of what was scored, the arms and a log.
    """
    p, method = protocol or Protocol(), METHODS[name]
    labeled = written(S.initial_labels(pool, p.initial, seed=p.seed).select(*pool.columns), "labeled")
    arms = written(A.bandit_init(labeled, pool.select(*PART).distinct()), "arms")
    seen = labeled.select(*ITEM)
    log: list[dict] = []
    for r in range(p.rounds):
        open_items = pool.join(labeled.select(*ITEM), ITEM, "left_anti")
        selected = written(A.bandit_select(arms, arms.withColumn("utility", F.lit(0.0)), p.selected, r + 2), "chosen")
        inside = open_items.join(small(selected.select(*PART)), PART, "left_semi")
        scored = written(scored_by(method, inside, labeled, p, p.seed + r, False), "scored")
        each = R.top_per(scored, F.col("mu").desc(), p.query, PART)  # no arm gives more
        arms_at_hand = selected.groupBy(*KEYS).agg(F.ceil(F.lit(p.query) / F.count("*")).alias("__quota"))
        batch = written(S.quota_fill(R.joined(each, arms_at_hand, KEYS, "inner"), F.col("__quota"), p.query, by_id=compat), "batch")
        arms = written(A.bandit_update(arms, selected, batch), "arms")
        labeled = written(labeled.unionByName(batch.select(*pool.columns)), "labeled")
        seen = written(seen.unionByName(scored.select(*ITEM)).distinct(), "seen")
        _logged(log, r, labeled)
    rows = written(scored_by(method, pool.join(seen, ITEM, "left_semi"), labeled, p, p.seed + p.rounds, True), "scored")
    return final_list(method, rows, name), arms, log


def local_scores(pool: DataFrame, coefficients: DataFrame, reservoir: int, fraction: float, keys=R.KEYS, seed: int = 0) -> DataFrame:
    """The one-shot scale query: what a pruned query scores, with mu and whether it was probed.

    Partitions are probed, ranked by the mean of their best quarter and a tenth of their vectors' spread, and
    a share of them is chosen. Only candidates are scored after the semi-join; probed rows keep their scores.
    """
    part = [*keys, "part_id"]
    probed = written(V.score_linear(S.reservoir_fixed(pool, reservoir, seed).drop("place"), coefficients, keys), "probed")
    spread = V.partition_spread(probed, part)
    useful = A.topmean(probed, 0.25, keys=part).join(spread, part).withColumn("utility", F.col("topmean") + F.lit(0.1) * F.col("spread"))
    useful = useful.withColumn("__most", F.greatest(F.lit(1), F.ceil(F.lit(fraction) * F.count("*").over(Window.partitionBy(*keys)))))  # one row a partition
    chosen = small(A.select_partitions(useful, F.col("__most"), keys).select(*part), "chosen")
    fresh = pool.join(chosen, part, "left_semi").join(probed.select(*keys, "item_id"), [*keys, "item_id"], "left_anti")
    columns = [*pool.columns, "mu"]
    scored = V.score_linear(fresh, coefficients, keys).select(*columns, F.lit(False).alias("probed"))
    return probed.select(*columns, F.lit(True).alias("probed")).unionByName(scored)


def scale_query(pool: DataFrame, coefficients: DataFrame, reservoir: int, fraction: float, k: int, keys=R.KEYS) -> DataFrame:
    """The k best of each target among what a pruned query scores, with their rank from 0."""
    top = R.top_per(local_scores(pool, coefficients, reservoir, fraction, keys), F.col("mu").desc(), k, keys)
    return top.withColumn("rank", R.rank(F.col("mu").desc(), keys))  # k rows a target


def scale_summary(pool: DataFrame, coefficients: DataFrame, reservoir: int, fraction: float, k: int, keys=R.KEYS) -> DataFrame:
    """What the pruned query saves and keeps: scores avoided, and its k best against those of the whole pool."""
    local = written(local_scores(pool, coefficients, reservoir, fraction, keys), "scored")
    counted = local.groupBy(*keys).agg(F.count("*").alias("locally_scored"), F.count_if("probed").alias("reservoir_scored"))
    sizes = pool.groupBy(*keys).agg(F.count("*").alias("library_size"))
    mine = R.top_per(local, F.col("mu").desc(), k, keys).select(*keys, "item_id")
    full = R.top_per(V.score_linear(pool, coefficients, keys), F.col("mu").desc(), k, keys).select(*keys, "item_id", F.lit(1).alias("__full"))
    shared = mine.join(full, [*keys, "item_id"], "left").groupBy(*keys).agg((F.count("__full") / F.count("*")).alias("topk_overlap"))
    out = sizes.join(counted, list(keys)).join(shared, list(keys))
    return out.withColumn("scores_avoided", F.lit(1.0) - F.col("locally_scored") / F.col("library_size"))


def random_controls(pool: DataFrame, n: int, seed: int = 0, keys=R.KEYS) -> DataFrame:
    """n random actives and n random decoys of each target."""
    place = F.row_number().over(Window.partitionBy(*keys, "label").orderBy(hash_order("item_id", seed, "control"), "item_id"))
    return pool.withColumn("place", place).where(F.col("place") <= n)
