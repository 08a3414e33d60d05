"""Methods: how a batch is acquired, how partitions are explored, and how the final list is ranked."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.functions.expr import hash_order
from budgetsieve.operators import ranking as R
from budgetsieve.operators import tops as T
from budgetsieve.sources.sinks import small, written


@dataclass(frozen=True)
class Method:
    """acquire: as acquired() knows it; explore: as utility() knows it, legacy, random, bandit, or None for the whole pool.

    model: linear, forest, extra (extremely randomised trees) or knn. Options: q, alert and novel (final score), weights (fusion), w (weight of the
    uncertainty in legacy scores), u (in the legacy utility), topmean (share of a partition's best).
    """

    acquire: str
    explore: str | None
    final: str
    options: tuple = ()
    model: str = "linear"

    def option(self, name: str, default):
        return dict(self.options).get(name, default)


def _family() -> dict[str, Method]:
    out = {
        "random": Method("random", None, "random"),
        "no_partition_reliable": Method("greedy", None, "risk"),
        "arm_ucb": Method("budgeted", "ucb", "mu"),
    }
    out["greedy_surrogate"] = Method("greedy", None, "mu")
    out["uncertainty_sampling"] = Method("uncertainty", None, "mu")
    out["knn_similarity"] = Method("greedy", None, "mu", model="knn")
    for name in ("greedy", "uncertainty", "ucb"):
        out[f"rf_{name}"] = Method(name, None, "mu", model="forest")
        out[f"et_{name}"] = Method(name, None, "mu", model="extra")
    budgeted = "budgeted_"
    for name in ("arm_risk_final", budgeted + "reliable"):
        out[name] = Method("budgeted", "ucb", "risk")
    out[budgeted + "reliable_random_parts"] = Method("budgeted", "random", "risk")
    out[budgeted + "reliable_clean_acq"] = Method("clean", "ucb", "risk")
    for q in (0.5, 0.9):
        out[f"{budgeted}reliable_q{int(100 * q)}"] = Method("budgeted", "ucb", "risk", (("q", q),))
    out[budgeted + "no_ucb_q90"] = Method("budgeted", "no_ucb", "risk", (("q", 0.9),))
    out[budgeted + "reliable_no_alert"] = Method("budgeted", "ucb", "risk", (("alert", 0.0),))
    out[budgeted + "reliable_no_novelty"] = Method("budgeted", "ucb", "risk", (("novel", 0.0),))
    out[budgeted + "reliable_no_density"] = Method("budgeted", "ucb", "risk", (("q", 1.0),))
    out[budgeted + "no_ucb"] = Method("budgeted", "no_ucb", "risk")
    out[budgeted + "no_ucb_no_density"] = Method("budgeted", "no_ucb", "risk", (("q", 1.0),))
    out[budgeted + "decay_ucb"] = Method("budgeted", "decay", "risk")
    out[budgeted + "decay_no_density"] = Method("budgeted", "decay", "risk", (("q", 1.0),))
    out[budgeted + "elite_decay"] = Method("budgeted", "decay", "risk", (("topmean", 0.01),))
    out[budgeted + "late_exploit"] = Method("budgeted", "late", "risk")
    out[budgeted + "no_ucb_soft_reliable"] = Method("budgeted", "no_ucb", "soft")
    out[budgeted + "no_ucb_hit_guard"] = Method("budgeted", "no_ucb", "guard")
    out[budgeted + "no_ucb_scaffaug_rerank"] = Method("budgeted", "no_ucb", "repeat")
    for name in R.RRF_WEIGHTS:
        out[f"{budgeted}no_ucb_pareto_rrf" + ("" if name == "default" else f"_{name}")] = Method("budgeted", "no_ucb", "rrf", (("weights", name),))
    for name, w, u, final in (
        ("legacy", 0.7, 1.5, "legacy"), ("legacy_mean_final", 0.7, 1.5, "mu"), ("legacy_conf03", 0.3, 1.5, "legacy"), ("legacy_no_conf", 0.0, 1.5, "legacy"),
        ("legacy_alloc_u05_mean", 0.3, 0.5, "mu"), ("legacy_alloc_u0_mean", 0.0, 0.0, "mu"), ("legacy_hit", 0.0, 0.0, "mu"),
        ("legacy_risk_constrained", 0.7, 1.5, "cut"), ("legacy_alloc_u0_risk", 0.7, 0.0, "cut"), ("legacy_reliable", 0.0, 0.0, "cut"), ("legacy_reliable_q90", 0.0, 0.0, "cut"), ("legacy_reliable_combo", 0.0, 0.0, "combo"),
    ):
        out[name] = Method("legacy", "legacy", final, (("w", w), ("u", u), ("q", 0.9 if name.endswith("q90") else 0.75)))
    out["full_greedy"] = Method("greedy", None, "mu")
    out["true_budgeted_reliable"] = Method("budgeted", "ucb", "rrf", (("weights", "no_conf"),))
    out["true_arm_risk_ranked"] = Method("budgeted", "bandit", "rrf", (("weights", "no_conf"),))
    return out


METHODS: dict[str, Method] = _family()


def final_scores(pool: DataFrame, method: str, keys=R.KEYS, seed: int = 0) -> DataFrame:
    """The pool with the method's final score; rows of scope are those of the pool that is passed in."""
    m = METHODS[method]
    o = dict(m.options)
    if m.final == "rrf":
        return R.rrf(pool, o["weights"], keys).withColumn("final", F.col("rrf"))
    if m.final == "risk":
        if o.get("q") == 1.0:
            out = R.zscored(R.with_novelty(pool, "nov", keys), ["nov"], keys)
            return out.withColumn("final", F.col("mu") + F.lit(0.05) * F.col("z_nov") - F.lit(0.1) * F.col("alert"))
        return R.risk_constrained(pool, o.get("q", 0.75), keys, o.get("alert", 0.1), o.get("novel", 0.05))
    if m.final == "soft":
        return R.soft_reliable(pool, keys)
    if m.final == "guard":
        return R.hit_guard(pool, keys=keys)
    if m.final == "repeat":
        out = R.zscored(R.with_novelty(pool, "nov", keys), ["nov"], keys)
        return R.scaffold_repeat(out.withColumn("base", F.col("mu") + F.lit(0.02) * F.col("z_nov") - F.lit(0.04) * F.col("alert")), "base", keys=keys)
    if m.final == "legacy":
        out = R.zscored(R.with_novelty(pool, "nov", keys), ["nov", "u_conf"], keys)
        return out.withColumn("final", F.col("mu") - F.lit(o["w"]) * F.col("z_u_conf") + F.lit(0.1) * F.col("z_nov") - F.lit(0.1) * F.col("alert"))
    if m.final in ("cut", "combo"):
        risky = pool.withColumn("risk", F.col("u_conf")) if m.final == "cut" else R.zscored(pool, ["u_conf", "u_epi"], keys).withColumn("risk", F.col("z_u_conf") + F.col("z_u_epi"))
        cut = R.quantile_of(risky, "risk", o["q"], "cut", keys)
        return cut.withColumn("final", F.when(F.col("risk") <= F.col("cut"), F.col("mu")).otherwise(F.col("mu") - 1.0))
    if m.final == "random":
        return pool.withColumn("final", F.conv(F.substring(hash_order("item_id", seed, "random"), 1, 12), 16, 10).cast("double"))
    return pool.withColumn("final", F.col("mu"))


def top_finals(pool: DataFrame, methods: Sequence[str], k: int, keys: Sequence[str] = R.KEYS) -> DataFrame:
    """(method, keys, item_id, label, score): the k best rows of each key under the final scores of methods.

    What the scores are made of (novelty, z-scores, quantiles) is made once, and one pass takes the best under all of
    them. For fusions it takes the first places of each list: an item behind these in all lists scores less than the
    k first of the main list do. Their places in the whole lists are counted, so that nothing is ranked as a whole.
    """
    own = [*keys, "item_id", "label", "alert", "scaffold", "mu", "u_conf", "u_epi"]
    base = written(R.with_novelty(pool.select(*own), "nov", keys), "novel")
    z = R.zscored(base, ["nov", "u_conf", "u_epi"], keys)
    c = F.col
    z = z.withColumn("__both", c("z_u_conf") + c("z_u_epi"))
    scores, fusions, cuts, repeated = {}, {}, {}, None

    def cut(value: str, q: float):
        cuts[name := f"__cut_{value.strip('_')}_{int(100 * q)}"] = (value, q)
        return c(name)

    for method in methods:
        m = METHODS[method]
        o = dict(m.options)
        if m.final == "rrf":
            fusions[method] = R.RRF_WEIGHTS[o["weights"]]
        elif m.final == "risk":
            q = o.get("q", 0.75)
            if q == 1.0:
                scores[method] = c("mu") + F.lit(0.05) * c("z_nov") - F.lit(0.1) * c("alert")
            else:
                score = c("mu") + F.lit(o.get("novel", 0.05)) * c("z_nov") - F.lit(o.get("alert", 0.1)) * c("alert")
                scores[method] = F.when(c("u_conf") <= cut("u_conf", q), score).otherwise(score - 1.0)
        elif m.final == "soft":
            scores[method] = c("mu") + F.lit(0.02) * c("z_nov") - F.lit(0.05) * c("alert") - F.lit(0.03) * c("z_u_conf")
        elif m.final == "guard":
            rest = c("mu") + F.lit(0.03) * c("z_nov") - F.lit(0.08) * c("alert") - F.lit(0.02) * c("z_u_conf")
            scores[method] = F.when(c("mu") >= cut("mu", 0.9), c("mu") - F.lit(0.01) * c("alert")).otherwise(rest)
        elif m.final == "repeat":
            repeated = method
        elif m.final == "legacy":
            scores[method] = c("mu") - F.lit(o["w"]) * c("z_u_conf") + F.lit(0.1) * c("z_nov") - F.lit(0.1) * c("alert")
        elif m.final in ("cut", "combo"):
            risk = "u_conf" if m.final == "cut" else "__both"
            scores[method] = F.when(c(risk) <= cut(risk, o["q"]), c("mu")).otherwise(c("mu") - 1.0)
        elif m.final == "random":
            scores[method] = F.conv(F.substring(hash_order("item_id", 0, "random"), 1, 12), 16, 10).cast("double")
        else:
            scores[method] = c("mu")
    for name, (value, q) in cuts.items():
        z = R.joined(z, small(R.quantiles(z, value, q, keys, name), "quantiles"), keys)
    orders = {"mu_rank": -c("mu"), "clean_rank": c("alert"), "conf_rank": c("u_conf"), "novel_rank": -c("nov")} if fusions else {}
    # behind so many places in all lists, an item has less than the k-th of the main list
    ahead = int(max((1 + sum(w) for w in fusions.values()), default=1.0) * (59 + k)) - 60 + 2
    best = T.top_of(z, scores | {f"list {n}": -o.cast("double") for n, o in orders.items()}, max(k, ahead), keys, ["label"])
    place = F.row_number().over(Window.partitionBy("method", *keys).orderBy(c("score").desc(), "item_id"))
    out = best.withColumnRenamed("kind", "method").where(~c("method").startswith("list "))
    if fusions:
        first = best.where(c("kind").startswith("list ")).select(*keys, "item_id", "label").distinct()
        ranks = R.joined(T.places(base, first, orders, keys), first, [*keys, "item_id"], "inner")
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), R.rrf_score(*w).alias("score")) for n, w in fusions.items()])).alias("f")
        out = out.unionByName(ranks.select(*keys, "item_id", "label", each).select(*keys, "item_id", "label", "f.*"))
    if repeated:
        rows = z.select(*keys, "item_id", "label", "scaffold", (c("mu") + F.lit(0.02) * c("z_nov") - F.lit(0.04) * c("alert")).alias("base"))
        out = out.unionByName(T.top_of(R.scaffold_repeat(rows, "base", keys=keys), {repeated: c("final")}, k, keys, ["label"]).withColumnRenamed("kind", "method"))
    return out.withColumn("__place", place).where(c("__place") <= k).drop("__place")
