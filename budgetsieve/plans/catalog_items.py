"""Queries over pools: sources, expressions, rankings, fusion, partitions, sampling, bandits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from budgetsieve.functions import expr as E
from budgetsieve.operators import allocation as A
from budgetsieve.operators import landmarks as B
from budgetsieve.operators import lists as N
from budgetsieve.operators import members as L
from budgetsieve.operators import ranking as R
from budgetsieve.operators import reporting as P
from budgetsieve.operators import sampling as S
from budgetsieve.operators import vectors as V
from budgetsieve.plans import loops
from budgetsieve.plans import protocols as PR
from budgetsieve.plans.catalog import query, rounded
from budgetsieve.plans.registry import METHODS, final_scores, top_finals
from budgetsieve.sources import readers
from budgetsieve.sources.mixture import mixture_pool, mixture_sql
from budgetsieve.sources.readers import vector_check
from budgetsieve.sources.sinks import shared_dir, small, written

KT = ["target"]
KP = ["target", "part_id"]

# ---- expressions


@query("zscore_global", "p", "SELECT item_id, round((mu - avg(mu) OVER ()) / (stddev_pop(mu) OVER () + 1e-8), 6) AS z FROM p")
def _(s):
    stats = s.p.agg(F.avg("mu").alias("m"), F.stddev_pop("mu").alias("sd"))  # one row, so that no task holds all items
    return rounded(s.p.crossJoin(F.broadcast(stats)).select("item_id", ((F.col("mu") - F.col("m")) / (F.col("sd") + F.lit(1e-8))).alias("z")), "z")


@query("zscore_partition", "p", "SELECT item_id, round((mu - avg(mu) OVER w) / (stddev_pop(mu) OVER w + 1e-8), 6) AS z FROM p WINDOW w AS (PARTITION BY target, part_id)")
def _(s):
    return rounded(R.zscored(s.p, ["mu"], KP).select("item_id", F.col("z_mu").alias("z")), "z")


@query("novelty", "o", "SELECT item_id, round(1.0e0 / count(*) OVER (PARTITION BY target, scaffold), 6) AS novelty FROM o")
def _(s):
    return rounded(R.with_novelty(s.o).select("item_id", "novelty"), "novelty")


@query("sigmoid_clip", "p", "SELECT item_id, round(1 / (1 + exp(-(mu * 4 - 2))), 6) AS s, round(greatest(least(mu, 0.9e0), 0.1e0), 6) AS c FROM p")
def _(s):
    return rounded(s.p.select("item_id", E.sigmoid(F.col("mu") * 4 - 2).alias("s"), E.clip("mu", 0.1, 0.9).alias("c")), "s", "c")


@query("l2_normalize", "v", "SELECT item_id, unnest(generate_series(0, len(x) - 1))::INT AS dim, round(unnest(list_transform(x, lambda a: a / greatest(sqrt(list_sum(list_transform(x, lambda b: b * b))), 1e-12))), 5) + 0.0e0 AS value FROM v")
def _(s):
    return rounded(s.v.select("item_id", F.posexplode(E.l2_normalize("x")).alias("dim", "value")), "value", places=5)


@query("safe_name", "", "SELECT DISTINCT p_partkey, substr(regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9_.-]+', '_', 'g'), 1, 120) AS name FROM part")
def _(s):
    return s.table("part").select("p_partkey", E.safe_name(F.concat_ws("/", "p_name", "p_brand")).alias("name")).distinct()


@query("string_offset", "", "SELECT n_name, (SELECT sum((i + 1) * ascii(substr(n_name, i::INT + 1, 1)))::BIGINT FROM range(0, length(n_name)) t(i)) AS seed_offset FROM nation")
def _(s):
    return s.table("nation").select("n_name", E.string_offset("n_name").alias("seed_offset"))


@query("metric_names", "", "SELECT p_partkey, replace(replace(replace(p_brand || '@' || p_size || '/2.5', '@', '_at_'), '/', '_'), '.', 'p') AS name FROM part")
def _(s):
    return s.table("part").select("p_partkey", E.metric_name(F.concat("p_brand", F.lit("@"), F.col("p_size").cast("string"), F.lit("/2.5"))).alias("name"))


@query("ucb_bonus", "p", "SELECT target, part_id, round(sqrt(2 * ln(greatest(2, 5)) / greatest(1, count(*))), 6) AS bonus FROM p GROUP BY ALL")
def _(s):
    return rounded(s.p.groupBy(*KP).agg(F.count("*").alias("n")).select(*KP, E.ucb_bonus(F.lit(5), F.col("n")).alias("bonus")), "bonus")


@query("hash_order", "o", "SELECT item_id, md5('7:demo:' || item_id) AS h FROM o")
def _(s):
    return s.o.select("item_id", E.hash_order("item_id", 7, "demo").alias("h"))


@query("bounding_box", "v", "SELECT class, round(avg(x[1]), 6) AS cx, round(avg(x[2]), 6) AS cy, round(avg(x[3]), 6) AS cz, round(greatest(max(x[1]) - min(x[1]) + 0.5e0, 0.8e0), 6) AS sx, round(greatest(max(x[2]) - min(x[2]) + 0.5e0, 0.8e0), 6) AS sy, round(greatest(max(x[3]) - min(x[3]) + 0.5e0, 0.8e0), 6) AS sz FROM v GROUP BY class")
def _(s):
    at = [F.element_at("x", i) for i in (1, 2, 3)]
    sizes = [F.greatest(F.max(a) - F.min(a) + F.lit(0.5), F.lit(0.8)) for a in at]
    out = s.v.groupBy("class").agg(*[F.avg(a).alias(n) for a, n in zip(at, ("cx", "cy", "cz"))], *[z.alias(n) for z, n in zip(sizes, ("sx", "sy", "sz"))])
    return rounded(out, "cx", "cy", "cz", "sx", "sy", "sz")


# ---- sources as relations


@query("pool_union_dedup", "", """WITH u AS (SELECT p_name AS name, 1 AS label, p_partkey AS item_id, 0 AS source_no FROM part WHERE p_size < 15 UNION ALL SELECT p_name, 0, p_partkey, 1 FROM part WHERE p_size >= 10)
SELECT name, label, item_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY source_no, item_id) AS n FROM u) WHERE n = 1""")
def _(s):
    part = s.table("part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("item_id"), "p_size")
    actives = part.where("p_size < 15").drop("p_size").withColumn("label", F.lit(1))
    decoys = part.where("p_size >= 10").drop("p_size").withColumn("label", F.lit(0))
    return P.union_dedup([actives, decoys], ["name"]).select("name", "label", "item_id")


@query("dedup_keep_last", "", """WITH u AS (SELECT o_custkey AS k, o_orderkey AS item_id, 0 AS source_no FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, o_orderkey, 1 FROM orders WHERE o_orderstatus <> 'F')
SELECT k, item_id, source_no::INT AS source_no FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source_no DESC, item_id) AS n FROM u) WHERE n = 1""")
def _(s):
    o = s.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("item_id"), "o_orderstatus")
    return P.union_dedup([o.where("o_orderstatus = 'F'").drop("o_orderstatus"), o.where("o_orderstatus <> 'F'").drop("o_orderstatus")], ["k"], "last").select("k", "item_id", "source_no")


@query("nested_prefix", "v", "SELECT size, item_id, prefix_rank FROM (SELECT item_id, row_number() OVER (ORDER BY md5('0:prefix:' || item_id), item_id)::INT AS prefix_rank FROM v), (VALUES (50), (100), (200)) t(size) WHERE prefix_rank <= size")
def _(s):
    return S.nested_prefix(s.v, [50, 100, 200])


@query("quantile_label", "o", "SELECT item_id, target, (mu >= q)::INT AS label FROM (SELECT *, quantile_cont(mu, 0.955e0) OVER (PARTITION BY target) AS q FROM o)")
def _(s):
    return R.quantile_of(s.o, "mu", 0.955, "cut").select("item_id", "target", (F.col("mu") >= F.col("cut")).cast("int").alias("label"))


def _text(s, lines, name):
    """Lines of text written to the shared folder, as an outside source would leave them."""
    path = f"{shared_dir(s.spark)}/{name}-{uuid.uuid4().hex}"
    lines.write.text(path)
    return path


@query("ism_round_trip", "", "SELECT 'C' || p_partkey AS smiles, p_partkey || '_' || p_size AS mol_id, 1 AS label FROM part")
def _(s):
    lines = s.table("part").select(F.concat_ws(" ", F.concat(F.lit("C"), "p_partkey"), "p_partkey", "p_size"))
    return readers.read_ism(s.spark, _text(s, lines, "ism"), 1)


@query("smi_round_trip", "", "SELECT 'C' || p_partkey AS smiles, p_partkey::VARCHAR AS mol_id, 0 AS label FROM part")
def _(s):
    lines = s.table("part").select(F.concat_ws("\t", F.concat(F.lit("C"), "p_partkey"), "p_partkey", "p_size"))
    return readers.read_smi(s.spark, _text(s, lines, "smi"), 0)


@query("name_list", "", "SELECT lower(n_name) AS name FROM nation")
def _(s):
    return readers.read_list(s.spark, _text(s, s.table("nation").select(F.concat(F.lit("  "), "n_name", F.lit("\n"))), "names")).select("name")


@query("tsv_aliases", "", "SELECT p_partkey::VARCHAR AS mol_id, p_brand AS smiles FROM part")
def _(s):
    path = f"{shared_dir(s.spark)}/tsv-{uuid.uuid4().hex}"
    s.table("part").select(F.col("p_partkey").alias("ChEMBL_ID"), F.col("p_brand").alias("Canonical_Smiles"), "p_size").write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)
    return readers.read_tsv(s.spark, path, {"mol_id": ["molecule_chembl_id", "chembl_id"], "smiles": ["canonical_smiles", "smiles"]})


@query("tagged_results", "r", "SELECT target, method, seed::INT AS seed, round(metric, 6) AS metric FROM r")
def _(s):
    """Results of each seed in files of their own, read back with their seed; rows differ in seed and keys."""
    specs = []
    for seed in range(3):
        path = f"{shared_dir(s.spark)}/seed{seed}-{uuid.uuid4().hex}"
        s.r.where(F.col("seed") == seed).select("target", "method", "metric").write.option("header", True).csv(path)
        specs.append(f"{seed}:{path}")
    return rounded(readers.read_tagged(s.spark, specs, "target long, method string, metric double", ["target", "method"]), "metric")


@query("dense_group_ids", "o", "SELECT item_id, scaffold, dense_rank() OVER (ORDER BY first) - 1 AS dense_id FROM (SELECT item_id, scaffold, min(item_id) OVER (PARTITION BY scaffold) AS first FROM o)")
def _(s):
    """Groups numbered by their first appearance."""
    return P.dense_ids(s.o.select("item_id", "scaffold"), "scaffold")


@query("first_valid_rows", "", "SELECT p_partkey, p_size FROM part WHERE p_size >= 10 ORDER BY p_partkey LIMIT 100")
def _(s):
    return P.first_valid(s.table("part").select("p_partkey", "p_size"), F.col("p_size") >= 10, 100, "p_partkey")


@query("stable_seeds", "", "SELECT p_partkey, ('0x' || substr(md5(p_name), 1, 15))::BIGINT % 2147483000 + 1 AS seed FROM part")
def _(s):
    return s.table("part").select("p_partkey", E.stable_seed("p_name").alias("seed"))


@query("prefix_files", "v", "SELECT item_id, prefix_rank FROM (SELECT item_id, row_number() OVER (ORDER BY md5('0:prefix:' || item_id), item_id) AS prefix_rank FROM v) WHERE prefix_rank <= 150")
def _(s):
    """Vectors stored in the order of a nested sample, of which a prefix is read."""
    path = f"{shared_dir(s.spark)}/prefix-{uuid.uuid4().hex}"
    order = [E.hash_order("item_id", 0, "prefix").asc(), F.col("item_id").asc()]
    readers.write_vectors(R.range_rank(s.v.select("item_id", "x"), order, "__place").withColumn("prefix_rank", F.col("__place") + 1).drop("__place"), path)
    return readers.read_prefix(s.spark, path, 150).select("item_id", "prefix_rank")


@query("shared_pool", "v", "SELECT item_id, 'alert' AS target, alert AS label FROM v UNION ALL SELECT item_id, 'third', coalesce((class = 3)::INT, 0) FROM v")
def _(s):
    """One pool under two labels, as loops take it."""
    both = loops.shared_pool(s.v.select("item_id", "alert", "class"), {"alert": F.col("alert"), "third": F.coalesce(F.col("class") == 3, F.lit(False))})
    return both.select("item_id", "target", "label")


@query("dataset_overview", "d", "SELECT target, sum(label)::BIGINT AS active, (count(*) - sum(label))::BIGINT AS decoy, count(*) AS library_size, round(sum(label) / count(*), 6) AS active_ratio FROM d GROUP BY target")
def _(s):
    out = s.d.groupBy("target").agg(F.sum("label").alias("active"), (F.count("*") - F.sum("label")).alias("decoy"), F.count("*").alias("library_size"), F.avg("label").alias("active_ratio"))
    return rounded(out, "active_ratio")


@query("vector_norm_check", "v", "SELECT count(*) AS n_rows, min(len(x))::INT AS low_dims, max(len(x))::INT AS high_dims, count(*) AS n_finite, round(avg(sqrt(list_sum(list_transform(x, lambda a: a * a)))), 5) AS mean_norm FROM v")
def _(s):
    return rounded(vector_check(s.v), "mean_norm", places=5)


@query("mixture_pool", "o", f"WITH {mixture_sql('o')} SELECT target, item_id, label, alert, scaffold, part_id, round(logit, 5) + 0.0e0 AS logit FROM mixture")
def _(s):
    """A seeded pool with an item for each order."""
    return rounded(mixture_pool(s.o.select("item_id")).drop("x"), "logit", places=5)


@query("upsample", "o", """WITH n AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM o),
d AS (SELECT draw, ('0x' || substr(md5('0:draw:' || draw), 1, 15))::BIGINT % (SELECT count(*) FROM o) AS i FROM range(2 * (SELECT count(*) FROM o)) t(draw))
SELECT draw, item_id FROM d JOIN n USING (i)""")
def _(s):
    rows = s.o.select("item_id")
    return S.upsample(rows, 2 * rows.count()).select("draw", "item_id")


# ---- ranks and fusion


@query("rank_desc", "o", "SELECT item_id, target, row_number() OVER (PARTITION BY target ORDER BY mu DESC, item_id) - 1 AS rank FROM o")
def _(s):
    return R.ranked(s.o.select("item_id", "target", "mu"), F.col("mu").desc()).select("item_id", "target", "rank")


@query("rank_asc", "o", "SELECT item_id, target, row_number() OVER (PARTITION BY target ORDER BY alert, item_id) - 1 AS rank FROM o")
def _(s):
    return R.ranked(s.o.select("item_id", "target", "alert"), F.col("alert").asc()).select("item_id", "target", "rank")


@query("rank_global", "p", "SELECT item_id, row_number() OVER (ORDER BY mu DESC, item_id) - 1 AS rank FROM p")
def _(s):
    return R.range_rank(s.p.select("item_id", "mu"), [F.col("mu").desc(), F.col("item_id").asc()]).select("item_id", F.col("rank").cast("long").alias("rank"))


def _rrf_sql(clean: float, conf: float, novel: float) -> str:
    terms = ["1.0e0 / (60 + row_number() OVER (PARTITION BY target ORDER BY mu DESC, item_id) - 1)"]
    for w, order in ((clean, "alert, item_id"), (conf, "u_conf, item_id"), (novel, "novelty DESC, item_id")):
        if w:
            terms.append(f"{w}e0 / (60 + row_number() OVER (PARTITION BY target ORDER BY {order}) - 1)")
    return f"""WITH n AS (SELECT *, 1.0e0 / count(*) OVER (PARTITION BY target, scaffold) AS novelty FROM o), f AS (SELECT item_id, target, {' + '.join(terms)} AS rrf FROM n)
SELECT item_id, target, round(rrf, 9) AS rrf, row_number() OVER (PARTITION BY target ORDER BY rrf DESC, item_id) - 1 AS rank FROM f"""


def _register_rrf(name: str, weights: tuple[float, float, float]) -> None:
    @query(f"rrf_{name}", "o", _rrf_sql(*weights))
    def _(s):
        return rounded(R.rrf(s.o, name).select("item_id", "target", "rrf", "rank"), "rrf", places=9)


for _name, _weights in R.RRF_WEIGHTS.items():
    _register_rrf(_name, _weights)


@query("scaffold_repeat_penalty", "o", "SELECT item_id, round(mu - 0.025e0 * ln(1 + row_number() OVER (PARTITION BY target, scaffold ORDER BY mu DESC, item_id) - 1), 6) AS final FROM o")
def _(s):
    return rounded(R.scaffold_repeat(s.o).select("item_id", "final"), "final")


_NOV = "WITH n AS (SELECT *, 1.0e0 / count(*) OVER (PARTITION BY target, scaffold) AS nov FROM o), z AS (SELECT *, (nov - avg(nov) OVER w) / (stddev_pop(nov) OVER w + 1e-8) AS zn, (u_conf - avg(u_conf) OVER w) / (stddev_pop(u_conf) OVER w + 1e-8) AS zc FROM n WINDOW w AS (PARTITION BY target))"


def _register_risk(q: float) -> None:
    @query(f"risk_constrained_q{int(q * 100)}", "o", f"{_NOV}, c AS (SELECT target, quantile_cont(u_conf, {q}e0) AS cut FROM o GROUP BY target) SELECT item_id, round(mu + 0.05e0 * zn - 0.1e0 * alert - CASE WHEN u_conf <= cut THEN 0 ELSE 1 END, 6) AS final FROM z JOIN c USING (target)")
    def _(s):
        return rounded(R.risk_constrained(s.o, q).select("item_id", "final"), "final")


for _q in (0.5, 0.75, 0.9):
    _register_risk(_q)


@query("soft_reliable", "o", f"{_NOV} SELECT item_id, round(mu + 0.02e0 * zn - 0.05e0 * alert - 0.03e0 * zc, 6) AS final FROM z")
def _(s):
    return rounded(R.soft_reliable(s.o).select("item_id", "final"), "final")


@query("hit_guard", "o", f"{_NOV}, c AS (SELECT target, quantile_cont(mu, 0.9e0) AS cut FROM o GROUP BY target) SELECT item_id, round(CASE WHEN mu >= cut THEN mu - 0.01e0 * alert ELSE mu + 0.03e0 * zn - 0.08e0 * alert - 0.02e0 * zc END, 6) AS final FROM z JOIN c USING (target)")
def _(s):
    return rounded(R.hit_guard(s.o).select("item_id", "final"), "final")


@query("legacy_final", "o", f"{_NOV} SELECT item_id, round(mu - 0.7e0 * zc + 0.1e0 * zn - 0.1e0 * alert, 6) AS final FROM z")
def _(s):
    return rounded(final_scores(s.o, "legacy").select("item_id", "final"), "final")


@query("acquisition_scores", "o", f"{_NOV} SELECT item_id, round(mu, 6) AS budgeted, round(mu - 0.05e0 * alert, 6) AS clean, round(mu + zc - 0.7e0 * zc - 0.2e0 * alert - 0.1e0 * zc, 6) AS legacy FROM z")
def _(s):
    o = s.o.withColumn("u_epi", F.col("u_conf"))
    for k in ("budgeted", "clean", "legacy"):
        o = A.acquired(o, k, name=k)
    return rounded(o.select("item_id", "budgeted", "clean", "legacy"), "budgeted", "clean", "legacy")


def _final_sql(final: str, o: dict) -> str:
    """A method's final score over the columns of f below."""
    if final == "rrf":
        clean, conf, novel = R.RRF_WEIGHTS[o["weights"]]
        return f"1.0e0 / (60 + mr) + {clean}e0 / (60 + cr) + {conf}e0 / (60 + ur) + {novel}e0 / (60 + nr)"
    if final == "risk":
        cut = "" if o.get("q") == 1.0 else f" - CASE WHEN u_conf <= q{int(100 * o.get('q', 0.75))} THEN 0 ELSE 1 END"
        return f"mu + {o.get('novel', 0.05)}e0 * zn - {o.get('alert', 0.1)}e0 * alert{cut}"
    return {
        "soft": "mu + 0.02e0 * zn - 0.05e0 * alert - 0.03e0 * zc",
        "guard": "CASE WHEN mu >= m90 THEN mu - 0.01e0 * alert ELSE mu + 0.03e0 * zn - 0.08e0 * alert - 0.02e0 * zc END",
        "repeat": "base - 0.025e0 * ln(1 + earlier)",
        "legacy": f"mu - {o.get('w')}e0 * zc + 0.1e0 * zn - 0.1e0 * alert",
        "cut": f"CASE WHEN u_conf <= q{int(100 * o.get('q', 0.75))} THEN mu ELSE mu - 1 END",
        "combo": "CASE WHEN 2 * zc <= d75 THEN mu ELSE mu - 1 END",
        "random": "('0x' || substr(md5('0:random:' || item_id), 1, 12))::BIGINT::DOUBLE",
        "mu": "mu",
    }[final]


def _kinds() -> dict[str, list[str]]:
    """Methods by what their final score is."""
    out: dict[str, list[str]] = {}
    for name in sorted(METHODS):
        out.setdefault(_final_sql(METHODS[name].final, dict(METHODS[name].options)), []).append(name)
    return out


_FINALS = f"""{_NOV}, r AS (SELECT *, 2 * zc AS d, mu + 0.02e0 * zn - 0.04e0 * alert AS base FROM z),
f AS (SELECT *, row_number() OVER (t ORDER BY mu DESC, item_id) - 1 AS mr, row_number() OVER (t ORDER BY alert, item_id) - 1 AS cr, row_number() OVER (t ORDER BY u_conf, item_id) - 1 AS ur, row_number() OVER (t ORDER BY nov DESC, item_id) - 1 AS nr,
  row_number() OVER (PARTITION BY target, scaffold ORDER BY base DESC, item_id) - 1 AS earlier, quantile_cont(u_conf, 0.5e0) OVER t AS q50, quantile_cont(u_conf, 0.75e0) OVER t AS q75, quantile_cont(u_conf, 0.9e0) OVER t AS q90,
  quantile_cont(mu, 0.9e0) OVER t AS m90, quantile_cont(d, 0.75e0) OVER t AS d75 FROM r WINDOW t AS (PARTITION BY target)),
s AS ({" UNION ALL ".join(f"SELECT '{names[0]}' AS kind, target, item_id, label, {score} AS final FROM f" for score, names in _kinds().items())}),
h AS (SELECT kind, target, sum(label)::BIGINT AS hits FROM (SELECT *, row_number() OVER (PARTITION BY kind, target ORDER BY final DESC, item_id) AS k FROM s) WHERE k <= 20 GROUP BY ALL),
m(kind, method) AS (VALUES {", ".join(f"('{names[0]}', '{n}')" for names in _kinds().values() for n in names)})
SELECT method, target, hits FROM h JOIN m USING (kind)"""


@query("method_registry", "o", _FINALS)
def _(s):
    kinds = {names[0]: names for names in _kinds().values()}  # methods with one final score share it
    top = top_finals(s.o.withColumn("u_epi", F.col("u_conf")), list(kinds), 20).withColumnRenamed("method", "kind")
    hits = top.groupBy("kind", "target").agg(F.sum("label").alias("hits"))
    named = s.spark.createDataFrame([(k, n) for k, names in kinds.items() for n in names], "kind string, method string")
    out = hits.join(F.broadcast(named), "kind")
    return out.select("method", "target", "hits")


@query("greedy_topk", "o", "SELECT item_id, round(mu, 6) AS mu FROM o ORDER BY o.mu DESC, item_id LIMIT 50")
def _(s):
    return rounded(R.top_k(s.o, "mu", 50).select("item_id", "mu"), "mu")


@query("rrf_weight_grid", "o", """WITH n AS (SELECT *, 1.0e0 / count(*) OVER (PARTITION BY target, scaffold) AS novelty FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mu DESC, item_id) - 1 AS mr, row_number() OVER (PARTITION BY target ORDER BY alert, item_id) - 1 AS cr, row_number() OVER (PARTITION BY target ORDER BY novelty DESC, item_id) - 1 AS nr FROM n),
g AS (SELECT k.*, c.w AS w_clean, d.w AS w_novel, 1.0e0 / (60.0e0 + mr) + c.w / (60.0e0 + cr) + d.w / (60.0e0 + nr) AS rrf FROM k, (VALUES (0.0e0), (0.18e0), (0.35e0)) c(w), (VALUES (0.0e0), (0.25e0)) d(w)),
t AS (SELECT *, row_number() OVER (PARTITION BY target, w_clean, w_novel ORDER BY rrf DESC, item_id) AS place FROM g)
SELECT target, w_clean, w_novel, sum(label)::BIGINT AS hits, round(avg(alert), 6) AS alerts FROM t WHERE place <= 100 GROUP BY ALL""")
def _(s):
    grid = s.spark.createDataFrame([(c, n) for c in (0.0, 0.18, 0.35) for n in (0.0, 0.25)], "w_clean double, w_novel double")
    return rounded(R.rrf_weight_grid(s.o, grid, 100), "alerts")


# ---- partitions and sampling


@query("topmean_q05", "o", "SELECT target, part_id, round(avg(mu), 6) AS topmean, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY mu DESC, item_id) AS place, count(*) OVER (PARTITION BY target, part_id) AS n FROM o) WHERE place <= greatest(1, ceil(n * 0.05e0)) GROUP BY ALL")
def _(s):
    return rounded(A.topmean(s.o, 0.05), "topmean")


@query("topmean_q25", "o", "SELECT target, part_id, round(avg(mu), 6) AS topmean, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY mu DESC, item_id) AS place, count(*) OVER (PARTITION BY target, part_id) AS n FROM o) WHERE place <= greatest(1, ceil(n * 0.25e0)) GROUP BY ALL")
def _(s):
    return rounded(A.topmean(s.o, 0.25), "topmean")


@query("partition_diversity", "o", "SELECT target, part_id, round(count(DISTINCT scaffold) / count(*), 6) AS diversity FROM o GROUP BY ALL")
def _(s):
    return rounded(A.diversity(s.o), "diversity")


@query("bincount_dense", "o", "SELECT k::INT AS part_id, coalesce(n, 0)::BIGINT AS n FROM range(80) t(k) LEFT JOIN (SELECT part_id, count(*) AS n FROM o GROUP BY part_id) ON part_id = k")
def _(s):
    return s.spark.range(80).select(F.col("id").cast("int").alias("part_id")).join(s.o.groupBy("part_id").agg(F.count("*").alias("n")), "part_id", "left").select("part_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


@query("partition_spread", "v", "SELECT part_id, round(avg(s), 6) AS spread FROM (SELECT part_id, dim, stddev_pop(value) AS s FROM (SELECT part_id, unnest(generate_series(1, len(x))) AS dim, unnest(x) AS value FROM v) GROUP BY ALL) GROUP BY part_id")
def _(s):
    return rounded(V.partition_spread(s.v), "spread")


@query("member_offsets", "o", "SELECT target, part_id, sum(n) OVER (PARTITION BY target ORDER BY part_id)::BIGINT - n AS start, n FROM (SELECT target, part_id, count(*) AS n FROM o GROUP BY ALL)")
def _(s):
    return L.member_lists(s.o).offsets


@query("member_slices", "o", """WITH n AS (SELECT target, part_id, item_id, row_number() OVER (PARTITION BY target ORDER BY part_id, item_id) - 1 AS place, row_number() OVER (PARTITION BY target, part_id ORDER BY item_id) AS nth FROM o)
SELECT target, part_id, item_id, place FROM n WHERE part_id % 8 = 3 AND nth <= 20""")
def _(s):
    """The first twenty members of some partitions."""
    lists = L.member_lists(s.o)
    return lists.slice_of(lists.offsets.where("part_id % 8 = 3"), 20).select("target", "part_id", "item_id", "place")


@query("partition_semi_join", "o", "SELECT item_id FROM o WHERE part_id IN (SELECT part_id FROM o GROUP BY part_id HAVING avg(mu) > (SELECT avg(mu) FROM o))")
def _(s):
    mean = s.o.agg(F.avg("mu").alias("all"))
    chosen = s.o.groupBy("part_id").agg(F.avg("mu").alias("m")).crossJoin(F.broadcast(mean)).where("m > all").select("part_id")
    return s.o.join(F.broadcast(chosen), "part_id", "left_semi").select("item_id")


@query("unlabeled_anti_join", "d", "SELECT doc_id AS item_id FROM documents WHERE doc_id NOT IN (SELECT item_id FROM d)")
def _(s):
    return s.table("documents").select(F.col("doc_id").alias("item_id")).join(s.table("labels").select(F.col("doc_id").alias("item_id")), "item_id", "left_anti")


@query("reservoir_fixed", "o", "SELECT item_id, target, part_id FROM (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY md5('0:reservoir:' || item_id), item_id) AS place FROM o) WHERE place <= 4")
def _(s):
    return S.reservoir_fixed(s.o, 4).select("item_id", *KP)


@query("reservoir_fraction", "o", "SELECT item_id, target, part_id FROM (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY md5('0:reservoir:' || item_id), item_id) AS place, count(*) OVER (PARTITION BY target, part_id) AS n FROM o) WHERE place <= least(n, 8, greatest(1, ceil(0.05e0 * n)))")
def _(s):
    return S.reservoir_fraction(s.o, 0.05, 8).select("item_id", *KP)


@query("initial_labels", "o", "SELECT item_id, target, label FROM (SELECT *, row_number() OVER (PARTITION BY target, label ORDER BY md5('0:initial:' || item_id), item_id) AS place FROM o) WHERE place <= CASE WHEN label = 1 THEN 2 ELSE 62 END")
def _(s):
    return S.initial_labels(s.o, 64).select("item_id", "target", "label")


@query("arm_quota_fill", "o", """WITH e AS (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY mu DESC, item_id) > 2 AS filled FROM o)
SELECT item_id, target, pick::INT AS pick FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY filled, mu DESC, item_id) AS pick FROM e) WHERE pick <= 150""")
def _(s):
    return S.quota_fill(s.o, 2, 150).select("item_id", "target", "pick")


_UTILITY = """WITH t AS (SELECT target, part_id, avg(mu) AS topmean, max(n) AS n FROM (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY mu DESC, item_id) AS place, count(*) OVER (PARTITION BY target, part_id) AS n FROM o) WHERE place <= greatest(1, ceil(n * {q}e0)) GROUP BY ALL),
d AS (SELECT target, part_id, count(DISTINCT scaffold) / count(*) AS diversity, sum(label) AS pulls, avg(alert) AS risk FROM o GROUP BY ALL)"""


def _register_utility(kind: str, factor: str) -> None:
    @query(f"partition_utility_{kind}", "o", f"{_UTILITY.format(q=0.05)} SELECT target, part_id, round(topmean + {factor} * sqrt(2 * ln(5.0e0) / greatest(1, pulls)) + 0.1e0 * diversity, 6) AS utility FROM t JOIN d USING (target, part_id)")
    def _(s):
        pulls = s.o.groupBy(*KP).agg(F.sum("label").alias("pulls"))
        return rounded(A.utility(s.o, pulls, 3, kind).select(*KP, "utility"), "utility")


for _kind, _factor in (("ucb", "1.0e0"), ("no_ucb", "0.0e0"), ("decay", "0.5e0"), ("late", "0.0e0")):
    _register_utility(_kind, _factor)


@query("partition_utility_legacy", "o", f"""{_UTILITY.format(q=0.05)}, u AS (SELECT target, part_id, avg(z) AS u FROM (SELECT *, (u_conf - avg(u_conf) OVER (PARTITION BY target)) / (stddev_pop(u_conf) OVER (PARTITION BY target) + 1e-8) + (mu - avg(mu) OVER (PARTITION BY target)) / (stddev_pop(mu) OVER (PARTITION BY target) + 1e-8) AS z FROM o) GROUP BY ALL)
SELECT target, part_id, round(topmean + 1.5e0 * u + sqrt(2 * ln(5.0e0) / greatest(1, pulls)) + 0.1e0 * diversity - 0.25e0 * risk, 6) AS utility FROM t JOIN d USING (target, part_id) JOIN u USING (target, part_id)""")
def _(s):
    pulls = s.o.groupBy(*KP).agg(F.sum("label").alias("pulls"))
    return rounded(A.utility_legacy(s.o.withColumn("u_epi", F.col("mu")), pulls, 3).select(*KP, "utility"), "utility")


_SELECTED = f"{_UTILITY.format(q=0.25)}, r AS (SELECT target, part_id, topmean + 0.1e0 * diversity AS utility, row_number() OVER (PARTITION BY target ORDER BY topmean + 0.1e0 * diversity DESC, part_id) - 1 AS part_rank FROM t JOIN d USING (target, part_id))"


def _utilities(pool):
    return A.topmean(pool, 0.25).join(A.diversity(pool), KP).withColumn("utility", F.col("topmean") + F.lit(0.1) * F.col("diversity"))


@query("select_partitions", "o", f"{_SELECTED} SELECT target, part_id, part_rank, round(utility, 6) AS utility FROM r WHERE part_rank < 8")
def _(s):
    return rounded(A.select_partitions(_utilities(s.o), 8).select(*KP, F.col("part_rank").cast("long").alias("part_rank"), "utility"), "utility")


@query("budget_fill", "o", f"""{_SELECTED}, p AS (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY md5('0:reservoir:' || item_id), item_id) <= 4 AS probed FROM o),
f AS (SELECT item_id, target, row_number() OVER (PARTITION BY target ORDER BY probed DESC, CASE WHEN probed THEN 0 ELSE part_rank END, md5('0:fill:' || item_id), item_id) AS spent FROM p JOIN r USING (target, part_id))
SELECT item_id, target, spent::INT AS spent FROM f WHERE spent <= 500""")
def _(s):
    ranks = A.select_partitions(_utilities(s.o), 64).select(*KP, "part_rank")
    return S.budget_fill(s.o, ranks, 500, 4).select("item_id", "target", "spent")


@query("budgeted_ranking", "o", """SELECT item_id, target, row_number() OVER (PARTITION BY target ORDER BY (md5('0:reservoir:' || item_id) < '4') DESC, mu DESC, item_id) - 1 AS rank FROM o""")
def _(s):
    o = s.o.select("item_id", "target", "mu", (E.hash_order("item_id", 0, "reservoir") < F.lit("4")).alias("scored"))
    return R.range_rank(o, [F.col("scored").desc(), F.col("mu").desc(), F.col("item_id").asc()], keys=KT).select("item_id", "target", "rank")


@query("allocation_routes", "o", """WITH p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY md5('0:reservoir:' || item_id), item_id) AS place FROM o) WHERE place <= 16),
m AS (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY mu DESC, item_id) AS pm, row_number() OVER (PARTITION BY target, part_id ORDER BY u_conf DESC, item_id) AS pu, count(*) OVER (PARTITION BY target, part_id) AS n FROM p),
a AS (SELECT target, part_id, max(n) AS n, avg(mu) AS mean, avg(CASE WHEN pm <= greatest(1, ceil(n * 0.25e0)) THEN mu END) AS topmean, avg(CASE WHEN pu <= greatest(1, ceil(n * 0.5e0)) THEN u_conf END) AS doubt, count(DISTINCT scaffold) / count(*) AS diversity FROM m GROUP BY ALL),
l AS (SELECT target, part_id, 'partitioned' AS route, topmean + 0.1e0 * diversity AS score FROM a UNION ALL SELECT target, part_id, 'mean_greedy', mean FROM a UNION ALL SELECT target, part_id, 'ucb', mean + 0.5e0 * sqrt(2.0e0 * ln(2.0e0) / n) FROM a
  UNION ALL SELECT target, part_id, 'random', ('0x' || substr(md5('0:route:' || part_id), 1, 8))::BIGINT::DOUBLE FROM a UNION ALL SELECT target, part_id, 'uncertainty', doubt FROM a)
SELECT target, part_id, route, round(score, 6) AS score, row_number() OVER (PARTITION BY target, route ORDER BY score DESC, part_id) - 1 AS part_rank FROM l""")
def _(s):
    return rounded(A.allocation_routes(S.reservoir_fixed(s.o, 16)).withColumn("part_rank", F.col("part_rank").cast("long")), "score")


_BANDIT = """WITH l AS (SELECT * FROM o WHERE md5('1:lab:' || item_id) < '1'), base AS (SELECT target, avg(label) AS base FROM l GROUP BY target), seen AS (SELECT target, part_id, avg(label) AS rate FROM l GROUP BY ALL),
arms AS (SELECT target, part_id, coalesce(base, 0) + coalesce(rate, 0) AS reward_sum, 1.0e0 + (rate IS NOT NULL)::INT AS pull_count FROM (SELECT DISTINCT target, part_id FROM o) LEFT JOIN base USING (target) LEFT JOIN seen USING (target, part_id))"""


def _arms(s):
    labeled = s.o.where(E.hash_order("item_id", 1, "lab") < F.lit("1"))
    return A.bandit_init(labeled, s.o.select(*KP).distinct())


@query("bandit_init", "o", f"{_BANDIT} SELECT target, part_id, round(reward_sum, 6) AS reward_sum, pull_count::DOUBLE AS pull_count FROM arms")
def _(s):
    return rounded(_arms(s), "reward_sum")


_SELECT_ARMS = f"{_BANDIT}, c AS (SELECT target, part_id, reward_sum / pull_count + 0.5e0 * sqrt(2 * ln(5.0e0) / greatest(pull_count, 1)) AS bound FROM arms), s AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(bound, 9) DESC, part_id) - 1 AS part_rank FROM c)"


def _select_arms(s):
    arms = _arms(s)
    bound = A.bandit_select(arms, arms.withColumn("utility", F.lit(0.0)), 1 << 20, 5)
    return A.select_partitions(bound.drop("part_rank").withColumn("bound", F.round("bound", 9)), 6, KT, "bound")


@query("bandit_select", "o", f"{_SELECT_ARMS} SELECT target, part_id, round(bound, 6) AS bound, part_rank FROM s WHERE part_rank < 6")
def _(s):
    return rounded(_select_arms(s).select(*KP, "bound", F.col("part_rank").cast("long").alias("part_rank")), "bound")


@query("bandit_update", "o", f"{_SELECT_ARMS}, b AS (SELECT target, part_id, avg(label) AS reward FROM (SELECT * FROM o WHERE item_id % 10 = 3) GROUP BY ALL) SELECT a.target, a.part_id, round(a.reward_sum + CASE WHEN s.part_rank < 6 THEN coalesce(b.reward, 0) ELSE 0 END, 6) AS reward_sum, (a.pull_count + (s.part_rank < 6)::INT)::DOUBLE AS pull_count FROM arms a JOIN s USING (target, part_id) LEFT JOIN b USING (target, part_id)")
def _(s):
    return rounded(A.bandit_update(_arms(s), _select_arms(s), s.o.where("item_id % 10 = 3")), "reward_sum")


@query("candidate_cap", "o", """WITH c AS (SELECT *, (part_id % 8 <> 0) AS filled FROM o), m AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY filled, md5('0:cap:' || item_id), item_id) AS place FROM c)
SELECT item_id, target FROM m WHERE CASE WHEN filled THEN place <= 32 ELSE place <= 128 END""")
def _(s):
    return A.candidate_cap(s.o.where("part_id % 8 = 0"), s.o.where("part_id % 8 <> 0"), 32, 4).select("item_id", "target")


@query("select_batch", "o", f"""{_SELECTED}, m AS (SELECT o.*, coalesce(r.part_rank < 4, false) AS inside FROM o LEFT JOIN r USING (target, part_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY inside DESC, CASE WHEN inside THEN mu END DESC NULLS LAST, md5('0:batch:' || item_id), item_id) AS place FROM m)
SELECT item_id, target, place::INT AS place FROM b WHERE place <= 64""")
def _(s):
    return A.select_batch(s.o, A.select_partitions(_utilities(s.o), 4), 64, F.col("mu")).select("item_id", "target", "place")


_SCALE = """WITH e AS (SELECT class, unnest(generate_series(1, len(x))) AS dim, unnest(x) AS value FROM v), c AS (SELECT class, list(m ORDER BY dim) AS w FROM (SELECT class, dim, avg(value) AS m FROM e GROUP BY ALL) GROUP BY class),
pl AS (SELECT v.item_id, v.part_id, v.x, c.class AS target, (v.class = c.class)::INT AS label, 1 / (1 + exp(-list_sum(list_transform(list_zip(v.x, c.w), lambda t: t[1] * t[2])))) AS mu FROM v, c WHERE c.class IS NOT NULL),
pr AS (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY mu DESC, item_id) AS pl, count(*) OVER (PARTITION BY target, part_id) AS n FROM pl QUALIFY row_number() OVER (PARTITION BY target, part_id ORDER BY md5('0:reservoir:' || item_id), item_id) <= 16),
pt AS (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY mu DESC, item_id) AS place, count(*) OVER (PARTITION BY target, part_id) AS size FROM pr),
tm AS (SELECT target, part_id, avg(mu) AS topmean FROM pt WHERE place <= greatest(1, ceil(size * 0.25e0)) GROUP BY ALL),
sp AS (SELECT target, part_id, avg(s) AS spread FROM (SELECT target, part_id, dim, stddev_pop(value) AS s FROM (SELECT target, part_id, unnest(generate_series(1, len(x))) AS dim, unnest(x) AS value FROM pr) GROUP BY ALL) GROUP BY ALL),
ch AS (SELECT target, part_id FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY topmean + 0.1e0 * spread DESC, part_id) AS k, count(*) OVER (PARTITION BY target) AS n FROM tm JOIN sp USING (target, part_id)) WHERE k <= greatest(1, ceil(0.1e0 * n))),
lo AS (SELECT item_id, target, label, mu, true AS probed FROM pr UNION ALL SELECT item_id, target, label, mu, false FROM (SELECT pl.* FROM pl SEMI JOIN ch USING (target, part_id)) f ANTI JOIN pr USING (target, item_id)),
lr AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mu DESC, item_id) - 1 AS rank FROM lo)"""


def _centroid_models(s):
    return V.class_centroids(s.v.where("class is not null")).select(F.col("class").alias("target"), F.lit(0).alias("member"), F.col("centroid").alias("w"), F.lit(0.0).alias("b"))


@query("scale_query", "v", f"{_SCALE} SELECT item_id, target, label, rank, round(mu, 6) AS mu FROM lr WHERE rank < 100")
def _(s):
    return rounded(loops.scale_query(_vector_pool(s), _centroid_models(s), 16, 0.1, 100).select("item_id", "target", "label", F.col("rank").cast("long").alias("rank"), "mu"), "mu")


@query("scale_summary", "v", f"""{_SCALE}, fr AS (SELECT target, item_id FROM pl QUALIFY row_number() OVER (PARTITION BY target ORDER BY mu DESC, item_id) <= 100),
ov AS (SELECT target, count(fr.item_id) / count(*) AS topk_overlap FROM (SELECT target, item_id FROM lr WHERE rank < 100) t LEFT JOIN fr USING (target, item_id) GROUP BY target)
SELECT target, (SELECT count(*) FROM v) AS library_size, count(*) AS locally_scored, count(*) FILTER (probed) AS reservoir_scored, round(1 - count(*) / (SELECT count(*) FROM v), 6) AS scores_avoided, round(max(topk_overlap), 6) AS topk_overlap FROM lo JOIN ov USING (target) GROUP BY target""")
def _(s):
    return rounded(loops.scale_summary(_vector_pool(s), _centroid_models(s), 16, 0.1, 100), "scores_avoided", "topk_overlap")


@query("score_reuse_union", "o", "SELECT item_id, target, CASE WHEN place <= 4 THEN 'reservoir' ELSE 'candidate' END AS origin FROM (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY md5('0:reservoir:' || item_id), item_id) AS place FROM o) WHERE place <= 4 OR part_id < 8")
def _(s):
    probed = S.reservoir_fixed(s.o, 4).select("item_id", "target", F.lit("reservoir").alias("origin"))
    fresh = s.o.where("part_id < 8").join(probed.select("item_id"), "item_id", "left_anti").select("item_id", "target", F.lit("candidate").alias("origin"))
    return probed.unionByName(fresh)


@query("export_candidates", "o", "SELECT target, item_id, scaffold, label, (row_number() OVER (PARTITION BY target ORDER BY mu DESC, item_id))::INT AS rank, round(mu, 6) AS mu, (md5('1:lab:' || item_id) < '1') AS was_queried FROM o QUALIFY row_number() OVER (PARTITION BY target ORDER BY o.mu DESC, item_id) <= 50")
def _(s):
    top = R.top_per(s.o, F.col("mu").desc(), 50).withColumn("rank", (R.rank(F.col("mu").desc()) + 1).cast("int"))  # of fifty a target
    return rounded(top.select("target", "item_id", "scaffold", "label", "rank", "mu", (E.hash_order("item_id", 1, "lab") < F.lit("1")).alias("was_queried")), "mu")


@query("control_sample", "o", "SELECT item_id, target, label FROM (SELECT *, row_number() OVER (PARTITION BY target, label ORDER BY md5('0:control:' || item_id), item_id) AS place FROM o) WHERE place <= 20")
def _(s):
    return loops.random_controls(s.o, 20).select("item_id", "target", "label")


# ---- vectors

_REF = "WITH ref AS (SELECT item_id, class, x FROM v WHERE md5('0:ref:' || item_id) < '2'), dist AS (SELECT v.item_id, ref.class, sqrt(list_sum(list_transform(list_zip(v.x, ref.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS dd, ref.item_id AS rid FROM v, ref)"


def _ref(s):
    return s.v.where(E.hash_order("item_id", 0, "ref") < F.lit("2"))


@query("knn_mean_distance", "v", f"{_REF} SELECT item_id, round(avg(dd), 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dd, rid) AS k FROM dist) WHERE k <= 5 GROUP BY item_id")
def _(s):
    return rounded(V.knn_mean_distance(s.v, _ref(s), 5), "distance", places=5)


@query("knn_class_margin", "v", f"{_REF} SELECT item_id, round(avg(dd) FILTER (NOT pos) - avg(dd) FILTER (pos), 5) AS margin FROM (SELECT *, class = 3 AS pos, row_number() OVER (PARTITION BY item_id, class = 3 ORDER BY dd, rid) AS k FROM dist) WHERE k <= 3 GROUP BY item_id")
def _(s):
    labeled = _ref(s).withColumn("label", (F.col("class") == 3).cast("int"))
    return rounded(V.knn_margin(s.v, labeled, 3).select("item_id", "margin"), "margin", places=5)


@query("knn_in_lists", "v", f"{_REF} SELECT item_id, round(avg(dd), 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY dd, rid) AS k FROM dist) WHERE k <= 3 GROUP BY item_id")
def _(s):
    """The same distances by inverted lists, as for a reference of any size."""
    near = N.Lists(_ref(s)).nearest(s.v, 3)
    return rounded(near.select("item_id", (F.aggregate("nearest", F.lit(0.0), lambda a, b: a + b) / F.size("nearest")).alias("distance")), "distance", places=5)


@query("retrieval_blend", "v", f"""{_REF}, m AS (SELECT item_id, min(dd) FILTER (class = 3) AS dp, min(dd) FILTER (class <> 3) AS dn FROM dist GROUP BY item_id), b AS (SELECT item_id, x[1] AS mu, dp, dn FROM m JOIN v USING (item_id)),
z AS (SELECT item_id, (mu - avg(mu) OVER ()) / (stddev_pop(mu) OVER () + 1e-8) AS zm, (-dp - avg(-dp) OVER ()) / (stddev_pop(-dp) OVER () + 1e-8) AS zp, (-dn - avg(-dn) OVER ()) / (stddev_pop(-dn) OVER () + 1e-8) AS zn FROM b)
SELECT item_id, round(1 / (1 + exp(-(zm + 0.5e0 * (zp - 0.5e0 * zn)))), 5) AS blended FROM z""")
def _(s):
    ref = _ref(s)
    near = V.knn_mean_distance(s.v, ref.where("class = 3"), 1, "dp").join(V.knn_mean_distance(s.v, ref.where("class <> 3"), 1, "dn"), "item_id").join(s.v.select("item_id", F.element_at("x", 1).alias("mu")), "item_id")
    neg = near.withColumns({"np": -F.col("dp"), "nn": -F.col("dn")})
    stats = neg.agg(*[f(c).alias(f"{n}_{c}") for c in ("mu", "np", "nn") for n, f in (("a", F.avg), ("s", F.stddev_pop))])
    z = lambda c: (F.col(c) - F.col(f"a_{c}")) / (F.col(f"s_{c}") + F.lit(1e-8))
    return rounded(neg.crossJoin(F.broadcast(stats)).select("item_id", E.sigmoid(z("mu") + F.lit(0.5) * (z("np") - F.lit(0.5) * z("nn"))).alias("blended")), "blended", places=5)


@query("nearest_centroid", "v", """WITH e AS (SELECT class, unnest(generate_series(1, len(x))) AS dim, unnest(x) AS value FROM v), m AS (SELECT class, dim, avg(value) AS m FROM e GROUP BY ALL), c AS (SELECT class, list(m ORDER BY dim) AS centroid FROM m GROUP BY class),
t AS (SELECT v.item_id, c.class, row_number() OVER (PARTITION BY item_id ORDER BY round(list_sum(list_transform(list_zip(v.x, c.centroid), lambda t: (t[1] - t[2]) * (t[1] - t[2]))), 9), c.class) AS k FROM v, c)
SELECT item_id, class AS part_id FROM t WHERE k = 1""")
def _(s):
    return V.nearest_centroid(s.v.drop("part_id"), V.class_centroids(s.v)).select("item_id", "part_id")


@query("signed_hash_projection", "d", """WITH tab AS (SELECT b::INT AS bit, (h % 96)::INT AS dim, CASE WHEN (h >> 16) & 1 = 1 THEN 1 ELSE -1 END AS sign FROM (SELECT b, (b * 2654435761 + 104729) % 4294967296 AS h FROM range(2048) t(b))),
b AS (SELECT DISTINCT item_id, (('0x' || substr(md5(w), 1, 8))::BIGINT % 2048)::INT AS bit FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM d)),
s AS (SELECT item_id, dim, sum(sign)::DOUBLE AS s FROM b JOIN tab USING (bit) GROUP BY ALL)
SELECT item_id, dim, round(s / greatest(sqrt(sum(s * s) OVER (PARTITION BY item_id)), 1e-12), 6) + 0.0e0 AS value FROM s""")
def _(s):
    return rounded(V.signed_hash_projection(V.shingle_bits(s.d)), "value")


@query("ensemble_mean_var", "o", "SELECT item_id, round(avg(p), 6) AS mu, round(var_pop(p), 6) AS u_epi FROM (SELECT item_id, 1 / (1 + exp(-(w * mu + b))) AS p FROM o, (VALUES (1.0e0, -0.5e0), (2.0e0, -1.0e0), (3.0e0, -1.2e0), (0.5e0, 0.1e0)) t(w, b)) GROUP BY item_id")
def _(s):
    coefficients = s.spark.createDataFrame([(0, [1.0], -0.5), (1, [2.0], -1.0), (2, [3.0], -1.2), (3, [0.5], 0.1)], "member int, w array<double>, b double")
    return rounded(V.score_linear(s.o.select("item_id", F.array("mu").alias("x")), coefficients).select("item_id", "mu", "u_epi"), "mu", "u_epi")


@query("cross_pool_scoring", "v", """WITH e AS (SELECT class, unnest(generate_series(1, len(x))) AS dim, unnest(x) AS value FROM v WHERE item_id % 2 = 0), c AS (SELECT class, list(m ORDER BY dim) AS w FROM (SELECT class, dim, avg(value) AS m FROM e GROUP BY ALL) GROUP BY class)
SELECT v.item_id, c.class AS target, round(1 / (1 + exp(-list_sum(list_transform(list_zip(v.x, c.w), lambda t: t[1] * t[2])))), 6) AS mu FROM v, c WHERE v.item_id % 2 = 1""")
def _(s):
    fitted = small(V.class_centroids(s.v.where("item_id % 2 = 0")).select(F.col("class").alias("target"), F.lit(0).alias("member"), F.col("centroid").alias("w"), F.lit(0.0).alias("b")))
    library = s.v.where("item_id % 2 = 1").select("item_id", "x").crossJoin(fitted.select("target"))
    return rounded(V.score_linear(library, fitted, KT).select("item_id", "target", "mu"), "mu")


@query("logistic_ensemble", "", "")
def _(s):
    labeled = _ref(s).withColumn("label", (F.col("class") == 3).cast("int"))
    return rounded(V.score_linear(s.v.select("item_id", "x"), V.logistic_ensemble(labeled, 5)).select("item_id", "mu", "u_epi"), "mu", "u_epi")


@query("assign_to_centres", "v", """WITH c AS (SELECT row_number() OVER (ORDER BY md5('0:centre:' || item_id), item_id) - 1 AS centre, x FROM v QUALIFY centre < (SELECT least(256, greatest(2, count(*) // 25)) FROM v)),
t AS (SELECT v.item_id, c.centre, sqrt(list_sum(list_transform(list_zip(v.x, c.x), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS d FROM v, c)
SELECT item_id, centre::INT AS part_id, round(d, 5) AS d FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(d, 9), centre) AS nth FROM t) WHERE nth = 1""")
def _(s):
    centres = N.centres_by_hash(s.v, V.partition_count(s.v.count()))
    return rounded(N.assign(s.v.drop("part_id"), centres, "part_id", "d").select("item_id", "part_id", "d"), "d", places=5)


@query("minibatch_partitions", "", "")
def _(s):
    centres = N.minibatch_kmeans(s.v, V.partition_count(s.v.count()))
    return N.assign(s.v.drop("part_id"), centres).groupBy("part_id").agg(F.count("*").alias("n"))


@query("kmeans_partitions", "", "")
def _(s):
    return V.nearest_centroid(s.v.drop("part_id"), V.kmeans(s.v, V.partition_count(s.v.count())), "part_id").groupBy("part_id").agg(F.count("*").alias("n"))


@query("svd_projection", "", "")
def _(s):
    return rounded(V.project(s.v.select("item_id", "x"), V.truncated_svd(s.v, 8)).select("item_id", F.posexplode("z").alias("dim", "value")), "value", places=5)


@query("landmark_projection", "", "")
def _(s):
    rows = V.shingle_bits(s.d).select("item_id", "bits")
    return rounded(B.project(rows, B.fit_basis(rows)).select("item_id", F.posexplode("z").alias("dim", "value")), "value")


@query("extra_tree_scores", "", "")
def _(s):
    labeled = _ref(s).withColumn("label", (F.col("class") == 3).cast("int"))
    return rounded(V.extra_tree_scores(s.v, labeled).select("item_id", "mu", "u_epi"), "mu", "u_epi")


@query("forest_scores", "", "")
def _(s):
    labeled = _ref(s).withColumn("label", (F.col("class") == 3).cast("int"))
    return rounded(V.forest_scores(s.v, labeled).select("item_id", "mu", "u_epi"), "mu", "u_epi")


def _vector_pool(s):
    targets = s.v.select(F.col("class").alias("target")).where("target is not null").distinct()
    return s.v.crossJoin(F.broadcast(targets)).withColumn("label", (F.col("class") == F.col("target")).cast("int")).drop("class")


def _protocol(s):
    return loops.Protocol.fitted(s.v.count(), selected=4)  # of sixteen partitions


def _listed(final):
    return rounded(final.where("rank < 1000").select("target", "item_id", "label", "rank", "final"), "final")


@query("full_pool_loop", "", "")
def _(s):
    return _listed(loops.full_pool(_vector_pool(s), "budgeted_decay_ucb", _protocol(s))[0])


@query("greedy_loop", "", "")
def _(s):
    return _listed(loops.full_pool(_vector_pool(s), "full_greedy", _protocol(s))[0])


@query("calibration_refit", "", "")
def _(s):
    p, pool = _protocol(s), _vector_pool(s)
    labeled = written(S.initial_labels(pool, 4 * p.initial, 4, p.seed).drop("place"), "labeled")
    return rounded(loops.calibrated(pool, labeled, p), "threshold", "coverage", "brier", "nll", "ece", "aurc")


@query("matched_protocol", "", "")
def _(s):
    """Four acquisitions from the same labels, eight rounds, one final fusion."""
    p = _protocol(s)
    p.final_blend = 0.5
    return rounded(PR.matched(_vector_pool(s), protocol=p)[0], "bedroc", "alert_free")


@query("encoding_control", "", "")
def _(s):
    """The pruned query under whole vectors and under their projection on eight landmark dimensions."""
    basis = B.fit_basis(s.v, 8, 64, "x", bits=False)
    rows = B.project(_vector_pool(s).select("item_id", "target", "label", "x"), basis, "x", bits=False)
    both = PR.encodings(rows, {"whole": F.col("x"), "landmark": F.col("z")}, V.partition_count(s.v.count()), 0.25, 8, 100)
    return rounded(both, "scores_avoided", "topk_overlap", "agreement")


@query("true_budget_loop", "", "")
def _(s):
    return _listed(loops.true_budget(_vector_pool(s), protocol=_protocol(s))[0])


@query("arm_bandit_loop", "", "")
def _(s):
    return _listed(loops.arm_bandit(_vector_pool(s), protocol=_protocol(s))[0])
