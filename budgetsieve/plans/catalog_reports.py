"""Queries over result tables: joins, deltas, pivots, overlaps, paired statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from budgetsieve.functions import expr as E
from budgetsieve.operators import ranking as R
from budgetsieve.operators import reporting as P
from budgetsieve.operators import stats as T
from budgetsieve.plans.catalog import query, rounded

METHODS = ["click", "error", "purchase", "signup", "view"]
_PAIR = "a AS (SELECT * FROM r WHERE method = 'click'), b AS (SELECT * FROM r WHERE method = 'purchase')"


@query("paired_join", "r", f"WITH {_PAIR} SELECT target, seed, round(a.metric, 6) AS metric_a, round(b.metric, 6) AS metric_b FROM a JOIN b USING (target, seed)")
def _(s):
    return rounded(P.paired(s.r, "click", "purchase", ["metric"]), "metric_a", "metric_b")


@query("paired_deltas_selfjoin", "r", "SELECT r.target, r.seed, r.method, round(r.metric - b.metric, 6) AS delta FROM r JOIN (SELECT * FROM r WHERE method = 'view') b USING (target, seed)")
def _(s):
    return rounded(P.deltas_join(s.r, "view").select("target", "seed", "method", "delta"), "delta")


@query("paired_deltas_window", "r", "SELECT target, seed, method, round(metric - max(CASE WHEN method = 'view' THEN metric END) OVER (PARTITION BY target, seed), 6) AS delta FROM r")
def _(s):
    return rounded(P.deltas(s.r, "view").select("target", "seed", "method", "delta"), "delta")


@query("baseline_delta", "r", "SELECT target, seed, method, round(metric - max(CASE WHEN method = 'error' THEN metric END) OVER w, 6) + 0.0e0 AS delta, round(metric / max(CASE WHEN method = 'error' THEN metric END) OVER w, 6) AS ratio FROM r WINDOW w AS (PARTITION BY target, seed)")
def _(s):
    base = F.max(F.when(F.col("method") == "error", F.col("metric"))).over(Window.partitionBy("target", "seed"))
    d = s.r.withColumn("base", base)
    return rounded(d.select("target", "seed", "method", (F.col("metric") - F.col("base")).alias("delta"), E.quotient("metric", "base").alias("ratio")), "delta", "ratio")


@query("validated_join", "r", f"WITH {_PAIR} SELECT target, seed, round(a.n, 6) AS n_a, round(b.n, 6) AS n_b FROM a JOIN b USING (target, seed)")
def _(s):
    keys = ["target", "seed"]
    a = P.one_row(s.r.where("method = 'click'"), keys).select(*keys, F.col("n").alias("n_a"))
    b = P.one_row(s.r.where("method = 'purchase'"), keys).select(*keys, F.col("n").alias("n_b"))
    return a.join(b, keys)


@query("candidate_left_join", "", """WITH t AS (SELECT o_custkey, o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_custkey, o_totalprice DESC, o_orderkey) - 1)::INT AS dock_id FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT dock_id, o_orderkey, c_name, coalesce(n_name, '') AS n_name FROM t LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT nation.* FROM nation JOIN region ON r_regionkey = n_regionkey WHERE r_name <> 'ASIA') ON n_nationkey = c_nationkey""")
def _(s):
    chosen = s.table("orders").where("o_orderpriority = '1-URGENT'").select("o_custkey", "o_totalprice", "o_orderkey")
    ids = R.range_rank(chosen, [F.col("o_custkey").asc(), F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], "dock_id")
    # unmatched nations are what the left join is for
    nations = s.table("nation").join(s.table("region").where("r_name <> 'ASIA'"), F.col("r_regionkey") == F.col("n_regionkey"))
    named = ids.join(s.table("customer"), F.col("c_custkey") == F.col("o_custkey"), "left").join(nations, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return named.select(F.col("dock_id").cast("int").alias("dock_id"), "o_orderkey", "c_name", F.coalesce("n_name", F.lit("")).alias("n_name"))


@query("candidate_dock_ids", "o", "SELECT item_id, target, (row_number() OVER (PARTITION BY target ORDER BY alert, mu DESC, item_id) - 1)::INT AS dock_id FROM o QUALIFY dock_id < 200")
def _(s):
    w = Window.partitionBy("target").orderBy("alert", F.desc("mu"), "item_id")
    return s.o.withColumn("dock_id", F.row_number().over(w) - 1).where("dock_id < 200").select("item_id", "target", "dock_id")


@query("group_summary", "r", "SELECT method, round(avg(metric), 6) AS metric_mean, round(stddev_samp(metric), 6) AS metric_std, round(avg(n), 6) AS n_mean, round(stddev_samp(n), 6) AS n_std, count(*) AS n FROM r GROUP BY method")
def _(s):
    return rounded(P.summary(s.r, ["method"], ["metric", "n"]), "metric_mean", "metric_std", "n_mean", "n_std")


@query("per_target_table", "r", "SELECT target, method, round(avg(metric), 6) AS metric, round(avg(n), 6) AS n, round(avg(top), 6) AS top FROM r GROUP BY ALL")
def _(s):
    return rounded(s.r.groupBy("target", "method").agg(*[F.avg(c).alias(c) for c in ("metric", "n", "top")]), "metric", "n", "top")


@query("main_table_mean_std", "r", "SELECT method, printf('%.4f +/- %.4f', avg(metric), stddev_samp(metric)) AS metric FROM r GROUP BY method")
def _(s):
    return s.r.groupBy("method").agg(E.mean_std("metric").alias("metric"))


@query("docking_summary", "o", "SELECT target, count(*) AS n, count(*) FILTER (alert = 0) AS ok, round(avg(mu) FILTER (alert = 0), 6) AS mean_ok, round(median(mu) FILTER (alert = 0), 6) AS median_ok, round(min(mu) FILTER (alert = 0), 6) AS best_ok, round(1 - count(*) FILTER (alert = 0) / count(*), 6) AS failed FROM o GROUP BY target")
def _(s):
    ok = F.when(F.col("alert") == 0, F.col("mu"))
    out = s.o.groupBy("target").agg(F.count("*").alias("n"), F.count_if(F.col("alert") == 0).alias("ok"), F.avg(ok).alias("mean_ok"), F.median(ok).alias("median_ok"), F.min(ok).alias("best_ok"), (F.lit(1.0) - F.count_if(F.col("alert") == 0) / F.count("*")).alias("failed"))
    return rounded(out, "mean_ok", "median_ok", "best_ok", "failed")


@query("overview_rollup", "r", "SELECT method, count(DISTINCT target) AS targets, count(DISTINCT seed) AS seeds, sum(n)::BIGINT AS rows_in, round(min(metric), 6) AS low, round(max(metric), 6) AS high, round(median(metric), 6) AS mid FROM r GROUP BY method")
def _(s):
    out = s.r.groupBy("method").agg(F.count_distinct("target").alias("targets"), F.count_distinct("seed").alias("seeds"), F.sum("n").cast("long").alias("rows_in"), F.min("metric").alias("low"), F.max("metric").alias("high"), F.median("metric").alias("mid"))
    return rounded(out, "low", "high", "mid")


_DELTA = "d AS (SELECT target, seed, method, metric - max(CASE WHEN method = 'view' THEN metric END) OVER (PARTITION BY target, seed) AS delta FROM r)"


def _deltas(s):
    return P.deltas(s.r, "view").where("delta IS NOT NULL")


@query("sign_counts", "r", f"WITH {_DELTA} SELECT method, count(*) FILTER (delta < -1e-12) AS negative, count(*) FILTER (abs(delta) <= 1e-12) AS zero, count(*) FILTER (delta > 1e-12) AS positive FROM d WHERE delta IS NOT NULL GROUP BY method")
def _(s):
    return P.delta_summary(_deltas(s)).select("method", "negative", "zero", "positive")


@query("delta_summary", "r", f"WITH {_DELTA} SELECT method, round(avg(delta), 6) AS mean, round(stddev_samp(delta), 6) AS std, round(median(delta), 6) AS median, round(min(delta), 6) AS low, round(max(delta), 6) AS high, count(*) FILTER (delta < -1e-12) AS negative, count(*) FILTER (abs(delta) <= 1e-12) AS zero, count(*) FILTER (delta > 1e-12) AS positive FROM d WHERE delta IS NOT NULL GROUP BY method")
def _(s):
    return rounded(P.delta_summary(_deltas(s)), "mean", "std", "median", "low", "high")


@query("favorable_delta", "r", f"WITH {_DELTA} SELECT method, round(avg(CASE WHEN method IN ('error') THEN -delta ELSE delta END), 6) AS favourable, round(avg(((CASE WHEN method IN ('error') THEN -delta ELSE delta END) > 0)::INT), 6) AS share FROM d WHERE delta IS NOT NULL GROUP BY method")
def _(s):
    signed = F.when(F.col("method") == "error", -F.col("delta")).otherwise(F.col("delta"))
    return rounded(_deltas(s).withColumn("f", signed).groupBy("method").agg(F.avg("f").alias("favourable"), F.avg((F.col("f") > 0).cast("double")).alias("share")), "favourable", "share")


@query("amortization", "r", "WITH c AS (SELECT method, sum(n) AS full, 2.5e0 * sum(n) AS \"index\", 0.4e0 * sum(n) AS online FROM r GROUP BY method) SELECT method, queries, round(queries * \"full\" / (\"index\" + queries * online), 6) AS speedup FROM c, (VALUES (1), (2), (5), (10), (20), (50), (100)) t(queries)")
def _(s):
    costs = s.r.groupBy("method").agg(F.sum("n").alias("full")).select("method", "full", (F.lit(2.5) * F.col("full")).alias("index"), (F.lit(0.4) * F.col("full")).alias("online"))
    return rounded(P.amortization(costs).select("method", "queries", "speedup"), "speedup")


@query("arg_max_row", "r", "SELECT method, round(metric, 6) AS metric, target, seed FROM r QUALIFY row_number() OVER (PARTITION BY method ORDER BY r.metric DESC, target DESC, seed DESC) = 1")
def _(s):
    return rounded(P.arg_max(s.r.select("method", "metric", "target", "seed"), "metric", ["method"]), "metric")


@query("weak_cases", "r", f"WITH {_DELTA} SELECT method, target, seed, round(delta, 6) AS delta FROM d WHERE delta IS NOT NULL AND method <> 'view' ORDER BY d.delta, target, seed, method LIMIT 20")
def _(s):
    return rounded(_deltas(s).where("method <> 'view'").orderBy("delta", "target", "seed", "method").limit(20).select("method", "target", "seed", "delta"), "delta")


@query("pairwise_set_overlap", "", """WITH t AS (SELECT DISTINCT event_type AS method, (day(ts) % 3)::INT AS seed, user_id % 5 AS target, user_id FROM events), a AS (SELECT seed, target, method, list(user_id) AS items FROM (SELECT *, row_number() OVER (PARTITION BY seed, target, method ORDER BY md5(method || user_id), user_id) AS k FROM t) WHERE k <= 15 GROUP BY ALL)
SELECT a.target::INT AS target, a.seed, a.method AS method_a, b.method AS method_b, len(list_intersect(a.items, b.items)) AS shared, round(len(list_intersect(a.items, b.items)) / (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items))), 6) AS jaccard, round(len(list_intersect(a.items, b.items)) / least(len(a.items), len(b.items)), 6) AS of_smaller, len(list_intersect(a.items, b.items)) = len(a.items) + len(b.items) - len(list_intersect(a.items, b.items)) AS identical_sets
FROM a JOIN a b ON a.seed = b.seed AND a.target = b.target AND a.method < b.method""")
def _(s):
    return rounded(P.overlaps(_top_sets(s)), "jaccard", "of_smaller")


def _top_sets(s):
    t = s.table("events").select(F.col("event_type").alias("method"), (F.dayofmonth("ts") % 3).alias("seed"), (F.col("user_id") % 5).cast("int").alias("target"), "user_id").distinct()
    w = Window.partitionBy("seed", "target", "method").orderBy(F.md5(F.concat("method", F.col("user_id").cast("string"))), "user_id")
    return t.withColumn("k", F.row_number().over(w)).where("k <= 15").groupBy("seed", "target", "method").agg(F.collect_list("user_id").alias("items"))


_SETS = """WITH t AS (SELECT DISTINCT event_type AS method, (day(ts) % 3)::INT AS seed, (user_id % 5)::INT AS target, user_id FROM events), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed, target, method ORDER BY md5(method || user_id), user_id) AS k FROM t) WHERE k <= 15)"""


@query("overlap_vs_baseline", "", f"{_SETS} SELECT a.target, a.seed, a.method, count(b.user_id) AS shared, round(count(b.user_id) / count(*), 6) AS share FROM k a LEFT JOIN (SELECT * FROM k WHERE method = 'view') b USING (target, seed, user_id) WHERE a.method <> 'view' GROUP BY ALL")
def _(s):
    each = _top_sets(s)
    base = each.where("method = 'view'").select("target", "seed", F.col("items").alias("base"))
    joined = each.where("method <> 'view'").join(base, ["target", "seed"], "left")
    shared = F.size(F.array_intersect("items", F.coalesce("base", F.array().cast("array<bigint>"))))
    return rounded(joined.select("target", "seed", "method", shared.cast("long").alias("shared"), (shared / F.size("items")).alias("share")), "share")


@query("jaccard_sets", "", f"{_SETS}, u AS (SELECT user_id, target, count(DISTINCT method) FILTER (method IN ('click', 'view')) AS m FROM k WHERE method IN ('click', 'view') GROUP BY ALL) SELECT target, round(count(*) FILTER (m = 2) / count(*), 6) AS jaccard FROM u GROUP BY target")
def _(s):
    each = _top_sets(s).where("method in ('click', 'view')").select("target", "method", F.explode("items").alias("user_id"))
    by_user = each.groupBy("user_id", "target").agg(F.count_distinct("method").alias("m"))
    return rounded(by_user.groupBy("target").agg((F.count_if(F.col("m") == 2) / F.count("*")).alias("jaccard")), "jaccard")


@query("first_seen_round", "", "SELECT user_id AS item_id, min((1 + (day(ts) - 1) // 4)::INT) AS first_round FROM events GROUP BY user_id")
def _(s):
    log = s.table("events").select(F.col("user_id").alias("item_id"), (F.lit(1) + F.floor((F.dayofmonth("ts") - 1) / 4)).cast("int").alias("round"))
    return P.first_seen(log)


_PIV = ", ".join(f"round(max(CASE WHEN method = '{m}' THEN {v} END), 6) AS {v}__{m}" for v in ("metric", "n") for m in ("click", "view"))


@query("paired_pivot", "r", f"SELECT target, seed, {_PIV}, round(max(CASE WHEN method = 'click' THEN metric END) - max(CASE WHEN method = 'view' THEN metric END), 6) AS metric_difference FROM r WHERE method IN ('click', 'view') GROUP BY ALL")
def _(s):
    wide = P.pivot(s.r.where("method in ('click', 'view')"), ["target", "seed"], "method", ["click", "view"], ["metric", "n"])
    wide = wide.withColumn("metric_difference", F.col("metric__click") - F.col("metric__view"))
    return rounded(wide, "metric__click", "metric__view", "n__click", "n__view", "metric_difference")


@query("decision_table", "r", f"""WITH {_DELTA}, m AS (SELECT method, 'mean' AS stat, avg(delta) AS v FROM d WHERE delta IS NOT NULL GROUP BY method UNION ALL SELECT method, 'median', median(delta) FROM d WHERE delta IS NOT NULL GROUP BY method UNION ALL SELECT method, 'worst', min(delta) FROM d WHERE delta IS NOT NULL GROUP BY method)
SELECT stat, {', '.join(f"round(max(v) FILTER (method = '{m}'), 6) AS v__{m}" for m in METHODS)} FROM m GROUP BY stat""")
def _(s):
    d = P.delta_summary(_deltas(s)).select("method", "mean", "median", F.col("low").alias("worst"))
    long = P.unpivot(d, ["method"], ["mean", "median", "worst"]).withColumnRenamed("metric_name", "stat").withColumnRenamed("value", "v")
    return rounded(P.pivot(long, ["stat"], "method", METHODS, ["v"]), *[f"v__{m}" for m in METHODS])


@query("unpivot_metrics", "r", "SELECT target, seed, method, metric_name, round(value, 6) AS value FROM (UNPIVOT (SELECT target, seed, method, metric, n, top FROM r) ON metric, n, top INTO NAME metric_name VALUE value)")
def _(s):
    return rounded(P.unpivot(s.r, ["target", "seed", "method"], ["metric", "n", "top"]), "value")


@query("docking_efficiency", "o", "WITH f AS (SELECT target, sum(label) AS hits, count(*) AS n FROM o GROUP BY target), b AS (SELECT target, sum(label) AS hits, count(*) AS n FROM o WHERE part_id < 16 GROUP BY target) SELECT target, round(1000.0e0 * b.hits / b.n, 6) AS hits_per_1000, round(1 - b.n / f.n, 6) AS saved, round(b.hits / greatest(1, f.hits), 6) AS retained FROM f JOIN b USING (target)")
def _(s):
    full = s.o.groupBy("target").agg(F.sum("label").alias("fh"), F.count("*").alias("fn"))
    used = s.o.where("part_id < 16").groupBy("target").agg(F.sum("label").alias("bh"), F.count("*").alias("bn"))
    out = full.join(used, "target").select("target", (F.lit(1000.0) * F.col("bh") / F.col("bn")).alias("hits_per_1000"), (F.lit(1.0) - F.col("bn") / F.col("fn")).alias("saved"), (F.col("bh") / F.greatest(F.lit(1), F.col("fh"))).alias("retained"))
    return rounded(out, "hits_per_1000", "saved", "retained")


# groups of three targets over all seeds, so that all sign patterns of a group can be listed
_SMALL = f"{_DELTA}, e AS (SELECT method, target // 3 AS grp, target, delta FROM d WHERE delta IS NOT NULL AND method <> 'view')"


def _small(s):
    return _deltas(s).where("method <> 'view'").withColumn("grp", F.floor(F.col("target") / 3))


@query("paired_permutation_exact", "r", f"""WITH {_SMALL}, l AS (SELECT method, grp, list(delta ORDER BY delta) AS d, count(*) AS n, avg(delta) AS m FROM e GROUP BY ALL),
f AS (SELECT method, grp, n, m, list_sum(list_transform(d, lambda x, i: x * (1 - 2 * ((pattern >> (i - 1)) & 1)))) / n AS fm FROM (SELECT *, unnest(range(1 << n::INT)) AS pattern FROM l))
SELECT method, grp, round(avg((abs(fm) >= abs(m) - 1e-12)::INT), 6) AS p, max(n) AS n FROM f GROUP BY ALL""")
def _(s):
    return rounded(T.permutation_exact(_small(s), ["method", "grp"]), "p")


@query("wilcoxon_statistic", "r", f"""WITH {_DELTA}, e AS (SELECT method, delta, abs(delta) AS a FROM d WHERE abs(delta) > 1e-12), k AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY a) + (count(*) OVER (PARTITION BY method, a) - 1) / 2.0e0 AS rk FROM e)
SELECT method, sum(CASE WHEN delta > 0 THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN delta < 0 THEN rk ELSE 0 END) AS w_minus, count(*) AS n FROM k GROUP BY method""")
def _(s):
    return T.wilcoxon(_deltas(s), ["method"]).select("method", "w_plus", "w_minus", "n")


#: The error function at |z| / sqrt(2) by a series of positive terms.
_ERF = "(2 / sqrt(pi()) * exp(-z * z / 2) * list_sum(list_transform(range(200), lambda n: exp(2 * n * ln(2.0e0) + (2 * n + 1) * ln(greatest(abs(z), 1e-300) / sqrt(2.0e0)) + lgamma(n + 1.0e0) - lgamma(2 * n + 2.0e0)))))"


@query("wilcoxon_p", "r", f"""WITH {_DELTA}, e AS (SELECT method, delta, abs(delta) AS a FROM d WHERE abs(delta) > 1e-12), k AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY a) + (count(*) OVER (PARTITION BY method, a) - 1) / 2.0e0 AS rk, count(*) OVER (PARTITION BY method, a) AS t FROM e),
w AS (SELECT method, sum(CASE WHEN delta > 0 THEN rk ELSE 0 END) AS w_plus, sum(CASE WHEN delta < 0 THEN rk ELSE 0 END) AS w_minus, count(*)::DOUBLE AS n, sum(t * t - 1) AS ties FROM k GROUP BY method),
z AS (SELECT *, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w) SELECT method, w_plus, w_minus, n::BIGINT AS n, round(z, 6) AS z, round(greatest(0, 1 - {_ERF}), 6) AS p FROM z""")
def _(s):
    return rounded(T.wilcoxon(_deltas(s), ["method"]).withColumn("p", T.normal_p(F.col("z"))), "z", "p")


_STATS = ("mean_delta", "median_delta", "min_delta", "negative_count", "p")


@query("decision_metrics", "r", f"""WITH l AS (SELECT target, seed, method, name, value FROM (UNPIVOT (SELECT target, seed, method, metric, n, top FROM r) ON metric, n, top INTO NAME name VALUE value)),
d AS (SELECT l.method, name, l.value - b.value AS delta FROM l JOIN (SELECT target, seed, name, value FROM l WHERE method = 'view') b USING (target, seed, name) WHERE l.method <> 'view'),
e AS (SELECT *, abs(delta) AS a FROM d WHERE abs(delta) > 1e-12), k AS (SELECT *, rank() OVER (PARTITION BY method, name ORDER BY a) + (count(*) OVER (PARTITION BY method, name, a) - 1) / 2.0e0 AS rk, count(*) OVER (PARTITION BY method, name, a) AS t FROM e),
w AS (SELECT method, name, sum(CASE WHEN delta > 0 THEN rk ELSE 0 END) AS w_plus, count(*)::DOUBLE AS n, sum(t * t - 1) AS ties FROM k GROUP BY ALL),
z AS (SELECT *, (w_plus - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48) AS z FROM w), p AS (SELECT method, name, greatest(0, 1 - {_ERF}) AS p FROM z),
s AS (SELECT method, name, avg(delta) AS mean_delta, median(delta) AS median_delta, min(delta) AS min_delta, count(*) FILTER (delta < -1e-12) AS negative_count FROM d GROUP BY ALL), j AS (SELECT s.*, p.p FROM s LEFT JOIN p ON p.method = s.method AND p.name = s.name)
SELECT method, {', '.join(f"round(max({x}) FILTER (name = '{m}'), 6) + 0.0e0 AS {m}_{x}" for m in ("metric", "n", "top") for x in _STATS)} FROM j GROUP BY method""")
def _(s):
    """One row a method against the reference: five statistics of the deltas of each metric."""
    metrics = ["metric", "n", "top"]
    long = P.unpivot(s.r, ["target", "seed", "method"], metrics)
    d = P.deltas_join(long, "view", "value", ["target", "seed", "metric_name"]).where("method <> 'view'")
    by = ["method", "metric_name"]
    p = T.wilcoxon(d, by).select(*by, T.normal_p(F.col("z")).alias("p"))
    told = P.delta_summary(d, by).select(*by, F.col("mean").alias("mean_delta"), F.col("median").alias("median_delta"), F.col("low").alias("min_delta"), F.col("negative").alias("negative_count"))
    both = R.joined(told, p, by)
    names = [(m, x) for m in metrics for x in _STATS]
    wide = both.groupBy("method").agg(*[F.max(F.when(F.col("metric_name") == m, F.col(x))).alias(f"{m}_{x}") for m, x in names])
    return rounded(wide, *[f"{m}_{x}" for m, x in names])


_SIGN = "c AS (SELECT method, grp, count(*) FILTER (delta > 1e-12) AS wins, count(*) FILTER (abs(delta) <= 1e-12) AS ties, count(*) FILTER (delta < -1e-12) AS losses FROM e GROUP BY ALL)"


@query("sign_test", "r", f"""WITH {_SMALL}, {_SIGN} SELECT method, grp, wins, ties, losses, round(least(1, 2 * list_sum(list_transform(range(least(wins, losses) + 1), lambda i: exp(lgamma(wins + losses + 1.0e0) - lgamma(i + 1.0e0) - lgamma(wins + losses - i + 1.0e0) - (wins + losses) * ln(2.0e0))))), 10) AS p FROM c""")
def _(s):
    return rounded(T.sign_test(_small(s), ["method", "grp"]), "p", places=10)


@query("sign_test_ties_improved", "r", f"""WITH {_SMALL}, {_SIGN} SELECT method, grp, wins, ties, losses, round(least(1, 2 * list_sum(list_transform(range(least(wins + ties, losses) + 1), lambda i: exp(lgamma(wins + ties + losses + 1.0e0) - lgamma(i + 1.0e0) - lgamma(wins + ties + losses - i + 1.0e0) - (wins + ties + losses) * ln(2.0e0))))), 10) AS p FROM c""")
def _(s):
    return rounded(T.sign_test(_small(s), ["method", "grp"], ties="improved"), "p", places=10)


@query("mann_whitney_u", "r", f"""WITH k AS (SELECT *, rank() OVER (PARTITION BY seed ORDER BY metric) + (count(*) OVER (PARTITION BY seed, metric) - 1) / 2.0e0 AS rk FROM r WHERE method IN ('click', 'view')),
u AS (SELECT seed, sum(rk) FILTER (method = 'click') - count(*) FILTER (method = 'click') * (count(*) FILTER (method = 'click') + 1) / 2.0e0 AS u, count(*) FILTER (method = 'click') AS n, count(*) FILTER (method = 'view') AS m FROM k GROUP BY seed)
SELECT seed, u, n, m, round(1 - u / (n * m), 6) AS p_lower, round(z, 6) AS z, round((1 + sign(z) * {_ERF}) / 2, 6) AS p FROM (SELECT *, (u - n * m / 2.0e0 + 0.5e0) / sqrt(n * m * (n + m + 1) / 12.0e0) AS z FROM u)""")
def _(s):
    return rounded(T.mann_whitney(s.r, ["seed"], "metric", "method", "click", "view").withColumn("p", T.normal_p(F.col("z"), two_sided=False)).select("seed", "u", "n", "m", "p_lower", "z", "p"), "p_lower", "z", "p")


@query("bootstrap_ci", "", "")
def _(s):
    return rounded(T.bootstrap_ci(_deltas(s).select("method", "target", "seed", "delta"), ["method"]), "mean", "low", "high")


@query("permutation_sampled", "", "")
def _(s):
    return rounded(T.permutation_sampled(_deltas(s), ["method"]), "p")


@query("matched_protocol_summary", "o", """WITH k AS (SELECT o.*, m.method, row_number() OVER (PARTITION BY target, m.method ORDER BY CASE m.method WHEN 'greedy' THEN mu WHEN 'uncertainty' THEN u_conf WHEN 'clean' THEN mu - 0.05e0 * alert ELSE 0 END DESC, item_id) AS place FROM o, (VALUES ('greedy'), ('uncertainty'), ('clean')) m(method))
SELECT target, method, count(*) AS queried, sum(label)::BIGINT AS hits, round(avg(alert), 6) AS alerts FROM k WHERE place <= 256 GROUP BY ALL""")
def _(s):
    scores = {"greedy": F.col("mu"), "uncertainty": F.col("u_conf"), "clean": F.col("mu") - F.lit(0.05) * F.col("alert")}
    long = s.o.withColumn("r", F.explode(F.array(*[F.struct(F.lit(k).alias("method"), v.alias("score")) for k, v in scores.items()]))).select("target", "item_id", "label", "alert", "r.*")
    top = R.top_per(long, F.col("score").desc(), 256, ["target", "method"])
    return rounded(top.groupBy("target", "method").agg(F.count("*").alias("queried"), F.sum("label").alias("hits"), F.avg("alert").alias("alerts")), "alerts")


@query("ablation_table", "r", "SELECT method AS comparison, 'metric' AS name, round(try_cast(printf('%.6f', avg(metric)) AS DOUBLE), 4) AS value FROM r WHERE method IN ('click', 'view') GROUP BY method UNION ALL SELECT method, 'n', round(try_cast(printf('%.6f', avg(n)) AS DOUBLE), 4) FROM r WHERE method IN ('click', 'signup') GROUP BY method")
def _(s):
    one = s.r.where("method in ('click', 'view')").groupBy(F.col("method").alias("comparison")).agg(F.format_string("%.6f", F.avg("metric")).alias("t")).withColumn("name", F.lit("metric"))
    two = s.r.where("method in ('click', 'signup')").groupBy(F.col("method").alias("comparison")).agg(F.format_string("%.6f", F.avg("n")).alias("t")).withColumn("name", F.lit("n"))
    return rounded(one.unionByName(two).select("comparison", "name", F.col("t").try_cast("double").alias("value")), "value", places=4)


@query("status_case", "r", "WITH t AS (SELECT DISTINCT target FROM r), m AS (SELECT DISTINCT method, seed FROM r) SELECT t.target, m.method, CASE WHEN count(r.seed) * 2 >= count(*) THEN 'done' WHEN count(r.seed) > 0 THEN 'partial' ELSE 'missing' END AS status FROM t CROSS JOIN m LEFT JOIN r ON r.target = t.target AND r.method = m.method AND r.seed = m.seed GROUP BY ALL")
def _(s):
    # what was planned: each method's seeds, a small table, for every target
    planned = s.r.groupBy("method").agg(F.count_distinct("seed").alias("planned"))
    found = s.r.groupBy("target", "method").agg(F.count("*").alias("found"))
    wanted = s.r.select("target").distinct().crossJoin(F.broadcast(planned))
    return wanted.join(found, ["target", "method"], "left").select("target", "method", P.status(F.coalesce("found", F.lit(0)) / F.col("planned")).alias("status"))
