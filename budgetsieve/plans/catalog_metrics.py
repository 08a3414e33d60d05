"""Queries for ranking, calibration, conformal and diversity metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from budgetsieve.functions import expr as E
from budgetsieve.operators import metrics as M
from budgetsieve.operators import ranking as R
from budgetsieve.operators import sampling as S
from budgetsieve.operators import vectors as V
from budgetsieve.plans import protocols as PR
from budgetsieve.plans.catalog import query, rounded
from budgetsieve.sources.sinks import small

KT = ["target"]
KS = (100, 500, 1000)
_RANK = "WITH r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mu DESC, item_id) - 1 AS rank FROM p)"
_K = "(VALUES (100), (500), (1000)) t(k)"


@query("hit_at_k", "p", f"{_RANK} SELECT target, k, sum(CASE WHEN rank < k THEN label ELSE 0 END)::BIGINT AS hits FROM r, {_K} GROUP BY ALL")
def _(s):
    return M.at_k(M.ranked(s.p), KS).select("target", "k", "hits")


@query("recall_at_k", "p", f"{_RANK} SELECT target, k, round(sum(CASE WHEN rank < k THEN label ELSE 0 END) / greatest(1, sum(label)), 6) AS recall FROM r, {_K} GROUP BY ALL")
def _(s):
    return rounded(M.at_k(M.ranked(s.p), KS).select("target", "k", "recall"), "recall")


@query("topk_metrics", "p", f"""{_RANK}, l AS (SELECT target, k, sum(label) FILTER (rank < k) AS hits FROM r, {_K} GROUP BY ALL)
SELECT target, max(hits) FILTER (k = 100)::BIGINT AS hits__100, max(hits) FILTER (k = 500)::BIGINT AS hits__500, max(hits) FILTER (k = 1000)::BIGINT AS hits__1000 FROM l GROUP BY target""")
def _(s):
    from budgetsieve.operators.reporting import pivot

    return pivot(M.at_k(M.ranked(s.p), KS), KT, "k", KS, ["hits"])


@query("unique_scaffolds_at_k", "p", f"{_RANK} SELECT target, k, count(DISTINCT CASE WHEN rank < k THEN scaffold END) AS groups FROM r, {_K} GROUP BY ALL")
def _(s):
    return M.at_k(M.ranked(s.p), KS).select("target", "k", "groups")


@query("alert_free_at_k", "p", f"{_RANK} SELECT target, k, round(1 - avg(CASE WHEN rank < k THEN alert END), 6) AS alert_free FROM r, {_K} GROUP BY ALL")
def _(s):
    return rounded(M.at_k(M.ranked(s.p), KS).select("target", "k", "alert_free"), "alert_free")


@query("enrichment_factor", "p", f"{_RANK}, n AS (SELECT target, count(*) AS n, avg(label) AS base FROM r GROUP BY target) SELECT target, round(avg(label) / greatest(max(base), 1e-12), 6) AS enrichment FROM r JOIN n USING (target) WHERE rank < greatest(1, round_even(n * 0.01e0, 0)) GROUP BY target")
def _(s):
    return rounded(M.enrichment(M.ranked(s.p), 0.01), "enrichment")


@query("bedroc", "p", f"""{_RANK}, b AS (SELECT target, count(*) AS n, sum(label) AS a FROM r GROUP BY target),
s AS (SELECT target, sum(CASE WHEN label = 1 THEN exp(-20.0e0 * (rank + 1) / n) ELSE 0 END) AS s, max(n) AS n, max(a) AS a FROM r JOIN b USING (target) GROUP BY target),
q AS (SELECT target, s / ((a / n) * (1 - exp(-20.0e0)) / (exp(20.0e0 / n) - 1)) AS rie, (1 - exp(20.0e0 * a / n)) / ((a / n) * (1 - exp(20.0e0))) AS lo, (1 - exp(-20.0e0 * a / n)) / ((a / n) * (1 - exp(-20.0e0))) AS hi FROM s)
SELECT target, round(greatest(least((rie - lo) / (hi - lo), 1), 0), 6) AS bedroc FROM q""")
def _(s):
    return rounded(M.bedroc(M.ranked(s.p)), "bedroc")


_CUM = "WITH c AS (SELECT target, round, sum(hits) OVER w AS h, sum(queried) OVER w AS n FROM q WINDOW w AS (PARTITION BY target ORDER BY round ROWS UNBOUNDED PRECEDING))"


@query("cumulative_hits", "q", f"{_CUM} SELECT target, round, h::BIGINT AS cumulative_hits, n::BIGINT AS cumulative_queried FROM c")
def _(s):
    return M.cumulative(s.q).select("target", "round", "cumulative_hits", "cumulative_queried")


@query("aubc_legacy", "q", f"{_CUM}, s AS (SELECT *, (h + lag(h) OVER w) / 2.0e0 * (round - lag(round) OVER w) AS step FROM c WINDOW w AS (PARTITION BY target ORDER BY round)) SELECT target, round(coalesce(sum(step), 0) / (max(round) * greatest(arg_max(h, round), 1)), 6) AS aubc FROM s GROUP BY target")
def _(s):
    return rounded(M.aubc_legacy(s.q), "aubc")


@query("aubc_recall", "q", f"{_CUM}, a AS (SELECT target, round::DOUBLE AS x, h + 2.0e0 AS y FROM c UNION ALL SELECT DISTINCT target, 0.0e0, 2.0e0 FROM q), s AS (SELECT *, (y + lag(y) OVER w) / 2.0e0 * (x - lag(x) OVER w) AS step FROM a WINDOW w AS (PARTITION BY target ORDER BY x)), n AS (SELECT target, sum(hits) + 2 AS positives FROM q GROUP BY target) SELECT target, round(sum(step) / (max(x) * max(positives)), 6) AS aubc FROM s JOIN n USING (target) GROUP BY target")
def _(s):
    positives = s.q.groupBy("target").agg((F.sum("hits") + 2).alias("positives"))  # a target's own: all that were found, and the two at the start
    return rounded(M.aubc_recall(s.q, 2, positives), "aubc")


@query("ece", "p", "WITH n AS (SELECT *, count(*) OVER (PARTITION BY target) AS n FROM p), b AS (SELECT target, floor(mu * 10) AS bin, count(*) / max(n) * abs(avg(label) - avg(mu)) AS part FROM n WHERE mu >= 0 AND mu < 1 GROUP BY ALL) SELECT target, round(sum(part), 6) AS ece FROM b GROUP BY target")
def _(s):
    return rounded(M.ece(s.p), "ece")


@query("brier", "p", "SELECT target, round(avg((mu - label) * (mu - label)), 6) AS brier FROM p GROUP BY target")
def _(s):
    return rounded(s.p.groupBy("target").agg(M.brier().alias("brier")), "brier")


@query("nll", "p", "SELECT target, round(-avg(label * ln(c) + (1 - label) * ln(1 - c)), 6) AS nll FROM (SELECT target, label, greatest(least(mu, 1 - 1e-7), 1e-7) AS c FROM p) GROUP BY target")
def _(s):
    return rounded(s.p.groupBy("target").agg(M.nll().alias("nll")), "nll")


@query("reliability_bins", "p", "SELECT target, least(floor(mu * 10), 9)::INT AS bin, count(*) AS n, round(avg(mu), 6) AS mean_p, round(avg(label), 6) AS rate, round(sqrt(avg(label) * (1 - avg(label)) / count(*)), 6) AS se FROM p GROUP BY ALL")
def _(s):
    return rounded(M.reliability(s.p), "mean_p", "rate", "se")


_CONF = "t AS (SELECT target, residual AS threshold FROM (SELECT target, abs(label - mu) AS residual, row_number() OVER (PARTITION BY target ORDER BY abs(label - mu), item_id) AS place, count(*) OVER (PARTITION BY target) AS n FROM p) WHERE place = greatest(1, least(n, ceil((n + 1) * 0.9e0))))"


@query("conformal_threshold", "p", f"WITH {_CONF} SELECT target, round(threshold, 6) AS threshold FROM t")
def _(s):
    return rounded(M.conformal_threshold(s.p), "threshold")


@query("conformal_coverage", "p", f"WITH {_CONF.replace('FROM p)', 'FROM p WHERE item_id % 2 = 0)')} SELECT target, round(avg((abs(label - mu) <= threshold)::INT), 6) AS coverage FROM p JOIN t USING (target) WHERE item_id % 2 = 1 GROUP BY target")
def _(s):
    return rounded(M.conformal_coverage(s.p.where("item_id % 2 = 1"), M.conformal_threshold(s.p.where("item_id % 2 = 0"))), "coverage")


@query("risk_coverage_auc", "p", """WITH w AS (SELECT target, row_number() OVER (PARTITION BY target ORDER BY u_conf, item_id) AS place, count(*) OVER (PARTITION BY target) AS n, avg(abs(label - mu)) OVER (PARTITION BY target ORDER BY u_conf, item_id ROWS UNBOUNDED PRECEDING) AS risk FROM p),
g AS (SELECT target, max(n) AS n, unnest(range(20)) AS i FROM w GROUP BY target), k AS (SELECT target, 0.05e0 + 0.95e0 * i / 19 AS c, ceil((0.05e0 + 0.95e0 * i / 19) * n)::BIGINT AS place FROM g),
s AS (SELECT target, (risk + lag(risk) OVER v) / 2 * (c - lag(c) OVER v) AS step FROM k JOIN w USING (target, place) WINDOW v AS (PARTITION BY target ORDER BY c))
SELECT target, round(sum(step) / 0.95e0, 6) AS aurc FROM s GROUP BY target""")
def _(s):
    return rounded(M.risk_coverage(s.p), "aurc")


_SPLIT = "SELECT *, n >= 2 AND place <= least(n - 1, greatest(1, round_even(n * 0.2e0, 0))) AS calibration FROM (SELECT *, row_number() OVER (PARTITION BY target, label ORDER BY md5('0:split:' || item_id), item_id) AS place, count(*) OVER (PARTITION BY target, label) AS n FROM d)"


@query("stratified_split", "d", f"SELECT item_id, target, calibration FROM ({_SPLIT})")
def _(s):
    return M.stratified_split(s.d).select("item_id", "target", "calibration")


@query("calibration_diagnostics", "p", f"""WITH sp AS ({_SPLIT.replace('FROM d)', 'FROM p)')}),
t AS (SELECT target, residual AS threshold FROM (SELECT target, abs(label - mu) AS residual, row_number() OVER (PARTITION BY target ORDER BY abs(label - mu), item_id) AS k, count(*) OVER (PARTITION BY target) AS m FROM sp WHERE calibration) WHERE k = greatest(1, least(m, ceil((m + 1) * 0.9e0))))
SELECT target, count(*) AS n_test, round(max(threshold), 6) AS threshold, round(avg((abs(label - mu) <= threshold)::INT), 6) AS coverage, round(avg((mu - label) * (mu - label)), 6) AS brier FROM sp JOIN t USING (target) WHERE NOT calibration GROUP BY target""")
def _(s):
    split = M.stratified_split(s.p)
    t = M.conformal_threshold(split.where("calibration"))
    test = split.where(~F.col("calibration")).join(small(t), "target")
    out = test.groupBy("target").agg(F.count("*").alias("n_test"), F.max("threshold").alias("threshold"), F.avg((F.abs(F.col("label") - F.col("mu")) <= F.col("threshold")).cast("double")).alias("coverage"), M.brier().alias("brier"))
    return rounded(out, "threshold", "coverage", "brier")


@query("unseen_scaffold_hit_rate", "o", """WITH l AS (SELECT DISTINCT target, scaffold FROM (SELECT *, row_number() OVER (PARTITION BY target, label ORDER BY md5('0:initial:' || item_id), item_id) AS place FROM o) WHERE place <= CASE WHEN label = 1 THEN 2 ELSE 62 END),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mu DESC, item_id) - 1 AS rank FROM o)
SELECT target, count(*) AS n, round(avg(label), 6) AS hit_rate FROM r ANTI JOIN l USING (target, scaffold) WHERE rank < 1000 GROUP BY target""")
def _(s):
    seen = S.initial_labels(s.o, 64).select("target", "scaffold").distinct()
    top = M.ranked(s.o).where("rank < 1000").join(seen, ["target", "scaffold"], "left_anti")
    return rounded(top.groupBy("target").agg(F.count("*").alias("n"), F.avg("label").alias("hit_rate")), "hit_rate")


@query("false_confidence_gap", "p", """WITH a AS (SELECT * FROM (SELECT *, quantile_cont(mu, 0.9e0) OVER (PARTITION BY target) AS q FROM p) WHERE mu >= q), b AS (SELECT *, quantile_cont(u_conf, 0.5e0) OVER (PARTITION BY target) AS m FROM a)
SELECT target, round(avg(label) FILTER (u_conf <= m) - avg(label) FILTER (u_conf > m), 6) AS gap FROM b GROUP BY target""")
def _(s):
    return rounded(M.false_confidence_gap(s.p), "gap")


@query("mean_pairwise_cosine", "v", """WITH t AS (SELECT class, item_id, list_transform(x, lambda a: a / sqrt(list_sum(list_transform(x, lambda b: b * b)))) AS u FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY x[1] DESC, item_id) AS k FROM v) WHERE k <= 20)
SELECT a.class, round(avg(1 - list_sum(list_transform(list_zip(a.u, b.u), lambda z: z[1] * z[2]))), 5) AS distance FROM t a JOIN t b ON a.class = b.class AND a.item_id < b.item_id GROUP BY a.class""")
def _(s):
    return rounded(M.mean_pairwise_cosine(s.v.withColumn("score", F.element_at("x", 1)), 20, ["class"]), "distance", places=5)


@query("mean_pairwise_tanimoto", "d", """WITH t AS (SELECT target, item_id, text FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mu DESC, item_id) AS k FROM d) WHERE k <= 10),
b AS (SELECT target, item_id, list_distinct(list_transform(list_distinct(string_split(lower(text), ' ')), lambda w: (('0x' || substr(md5(w), 1, 8))::BIGINT % 2048)::INT)) AS bits FROM t)
SELECT a.target, round(avg(1 - len(list_intersect(a.bits, b.bits)) / (len(a.bits) + len(b.bits) - len(list_intersect(a.bits, b.bits)))), 6) AS distance FROM b a JOIN b b ON a.target = b.target AND a.item_id < b.item_id GROUP BY a.target""")
def _(s):
    top = R.top_per(s.d, F.col("mu").desc(), 10)
    return rounded(M.mean_pairwise_tanimoto(V.shingle_bits(top).withColumn("score", F.col("mu")), 10, KT), "distance")


@query("structural_alerts", "d", "SELECT item_id, regexp_matches(text, '[%$&#*]{3}')::INT AS symbol_alert, regexp_matches(text, '[A-Z]{6}')::INT AS shout_alert, greatest(regexp_matches(text, '[%$&#*]{3}')::INT, regexp_matches(text, '[A-Z]{6}')::INT) AS risk_alert FROM d")
def _(s):
    a, b = F.col("text").rlike("[%$&#*]{3}").cast("int"), F.col("text").rlike("[A-Z]{6}").cast("int")
    return s.d.select("item_id", a.alias("symbol_alert"), b.alias("shout_alert"), F.greatest(a, b).alias("risk_alert"))


@query("inference_budget_analytic", "o", "SELECT target, count(*) AS n, count(*) * 9 AS full_cost, (512 + 16 * least(256, greatest(1, round_even(0.05e0 * count(*) / 16.0e0, 0)))::BIGINT + 8 * 64)::BIGINT AS budget_cost, round(1 - (512 + 16 * least(256, greatest(1, round_even(0.05e0 * count(*) / 16.0e0, 0)))::BIGINT + 8 * 64) / (count(*) * 9), 6) AS saved FROM o GROUP BY target")
def _(s):
    from budgetsieve.operators.reporting import inference_budget

    return rounded(inference_budget(s.o.groupBy("target").agg(F.count("*").alias("n")), 16, 8, 64, 512), "saved")


@query("inference_budget_actual", "o", "SELECT target, count(*) FILTER (place <= 4 OR part_id < 8) AS used, count(*) * 4 AS full_cost, round(1 - count(*) FILTER (place <= 4 OR part_id < 8) / (count(*) * 4), 6) AS saved FROM (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY md5('0:reservoir:' || item_id), item_id) AS place FROM o) GROUP BY target")
def _(s):
    marked = S.placed(s.o, ["target", "part_id"], 0, "reservoir")
    used = F.count_if((F.col("place") <= 4) | (F.col("part_id") < 8))
    return rounded(marked.groupBy("target").agg(used.alias("used"), (F.count("*") * 4).alias("full_cost"), (F.lit(1.0) - used / (F.count("*") * 4)).alias("saved")), "saved")


@query("budget_quality_curve", "o", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mu DESC, item_id) - 1 AS full_rank, row_number() OVER (PARTITION BY target ORDER BY md5('0:fill:' || item_id), item_id) AS spent, count(*) OVER (PARTITION BY target) AS n FROM o),
b AS (SELECT r.*, t.ratio, row_number() OVER (PARTITION BY target, ratio ORDER BY mu DESC, item_id) - 1 AS rank FROM r, (VALUES (0.05e0), (0.1e0), (0.25e0), (0.5e0), (1.0e0)) t(ratio) WHERE spent <= least(n, greatest(least(100, n), ceil(ratio * n))))
SELECT target, ratio, count(*) AS scored, sum(label) FILTER (rank < 100)::BIGINT AS hits, round(count(*) FILTER (rank < 100 AND full_rank < 100) / 100, 6) AS overlap FROM b GROUP BY ALL""")
def _(s):
    rows = R.ranked(s.o.select("item_id", "target", "mu", "label"), F.col("mu").desc(), "full_rank").withColumn("h", E.hash_order("item_id", 0, "fill"))
    spent = R.range_rank(rows, [F.col("h").asc(), F.col("item_id").asc()], "spent", KT)
    sized = R.joined(spent, small(s.o.groupBy("target").agg(F.count("*").alias("n"))), KT)
    each = sized.withColumn("ratio", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.25, 0.5, 1.0)])))
    inside = each.where(F.col("spent") < F.least(F.col("n"), F.greatest(F.least(F.lit(100), F.col("n")), F.ceil(F.col("ratio") * F.col("n")))))
    scored = inside.groupBy("target", "ratio").agg(F.count("*").alias("scored"))
    top = R.top_per(inside, F.col("mu").desc(), 100, ["target", "ratio"])
    found = top.groupBy("target", "ratio").agg(F.sum("label").alias("hits"), (F.count_if(F.col("full_rank") < 100) / 100).alias("overlap"))
    return rounded(scored.join(found, ["target", "ratio"]), "overlap")


def _cells(ratios, routes) -> str:
    """budget_cells over the pool o, by windows."""
    return f"""WITH ratios(ratio) AS (VALUES {", ".join(f"({x!r}::DOUBLE)" for x in ratios)}), pulls AS (SELECT target, part_id, count(*) AS pulls FROM o WHERE md5('1:lab:' || item_id) < '1' GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY md5('0:reservoir:' || item_id), item_id) <= 4 AS probed FROM o),
g AS (SELECT *, row_number() OVER (PARTITION BY target, part_id ORDER BY mu DESC, item_id) AS pm, row_number() OVER (PARTITION BY target, part_id ORDER BY u_conf DESC, item_id) AS pu, count(*) OVER (PARTITION BY target, part_id) AS n FROM m WHERE probed),
a AS (SELECT target, part_id, avg(mu) AS mean, avg(mu) FILTER (pm <= greatest(1, ceil(n * 0.25e0))) + 0.1e0 * (count(DISTINCT scaffold) / count(*)) AS useful, avg(u_conf) FILTER (pu <= greatest(1, ceil(n * 0.5e0))) AS doubt FROM g GROUP BY ALL),
l AS (SELECT target, part_id, route, round(CASE route WHEN 'partitioned' THEN useful WHEN 'partitioned_ucb' THEN useful + 0.5e0 * sqrt(2.0e0 * ln(2.0e0) / greatest(coalesce(pulls, 0), 1)) WHEN 'mean_greedy' THEN mean WHEN 'random' THEN ('0x' || substr(md5('0:route:' || part_id), 1, 8))::BIGINT::DOUBLE ELSE doubt END, 9) AS score
  FROM a LEFT JOIN pulls USING (target, part_id), (VALUES {", ".join(f"('{r}')" for r in routes)}) t(route)),
r AS (SELECT *, row_number() OVER (PARTITION BY target, route ORDER BY score DESC, part_id) - 1 AS part_rank FROM l),
s AS (SELECT m.*, route, row_number() OVER (PARTITION BY target, route ORDER BY CASE WHEN probed THEN -1 ELSE part_rank END, md5('0:fill:' || item_id), item_id) - 1 AS spent, count(*) OVER (PARTITION BY target, route) AS n, count(*) FILTER (probed) OVER (PARTITION BY target, route) AS probes FROM m JOIN r USING (target, part_id)),
e AS (SELECT *, spent < least(n, greatest(least(1000, n), ceil(ratio * n), probes)) AS scored FROM s, ratios),
v AS (SELECT *, 1.0e0 / count(*) OVER (PARTITION BY target, route, ratio, scaffold) AS novelty FROM e WHERE scored),
k AS (SELECT *, 1.0e0 / (60 + row_number() OVER (PARTITION BY target, route, ratio ORDER BY mu DESC, item_id) - 1) + 0.18e0 / (60 + row_number() OVER (PARTITION BY target, route, ratio ORDER BY alert, item_id) - 1) + 0.25e0 / (60 + row_number() OVER (PARTITION BY target, route, ratio ORDER BY novelty DESC, item_id) - 1) AS rrf FROM v),
f AS (SELECT e.target, e.route, e.ratio, e.item_id, e.label, e.alert, e.scaffold, e.scored, row_number() OVER (PARTITION BY e.target, e.route, e.ratio ORDER BY k.rrf DESC NULLS LAST, e.item_id) - 1 AS rank FROM e LEFT JOIN k USING (target, route, ratio, item_id)),
w AS (SELECT *, 1.0e0 / count(*) OVER (PARTITION BY target, scaffold) AS novelty FROM o),
x AS (SELECT *, 1.0e0 / (60 + row_number() OVER (PARTITION BY target ORDER BY mu DESC, item_id) - 1) + 0.18e0 / (60 + row_number() OVER (PARTITION BY target ORDER BY alert, item_id) - 1) + 0.25e0 / (60 + row_number() OVER (PARTITION BY target ORDER BY novelty DESC, item_id) - 1) AS rrf FROM w),
y AS (SELECT target, item_id, label FROM x QUALIFY row_number() OVER (PARTITION BY target ORDER BY rrf DESC, item_id) <= 1000), h AS (SELECT target, sum(label) AS full_hits, count(*) AS full_n FROM y GROUP BY target),
z AS (SELECT f.target, route, ratio, count(*) FILTER (scored) AS scored, count(*) AS n, sum(f.label) AS a, sum(f.label) FILTER (rank < 1000) AS hits, 1 - avg(alert) FILTER (rank < 1000) AS alert_free, count(DISTINCT scaffold) FILTER (rank < 1000) AS groups, count(y.item_id) FILTER (rank < 1000) AS shared FROM f LEFT JOIN y ON y.target = f.target AND y.item_id = f.item_id GROUP BY ALL),
b AS (SELECT f.target, f.route, f.ratio, sum(CASE WHEN label = 1 THEN exp(-20.0e0 * (rank + 1) / n) ELSE 0 END) AS s FROM f JOIN z ON z.target = f.target AND z.route = f.route AND z.ratio = f.ratio GROUP BY ALL),
c AS (SELECT *, a / n AS q, s / ((a / n) * (1 - exp(-20.0e0)) / (exp(20.0e0 / n) - 1)) AS rie FROM z JOIN b USING (target, route, ratio) JOIN h USING (target))
SELECT target, route, ratio, scored, round(scored / n, 6) AS realized, hits::BIGINT AS hits, round(hits / greatest(full_hits, 1), 6) AS retention,
  round(greatest(0, least(1, (rie - (1 - exp(20.0e0 * q)) / (q * (1 - exp(20.0e0)))) / ((1 - exp(-20.0e0 * q)) / (q * (1 - exp(-20.0e0))) - (1 - exp(20.0e0 * q)) / (q * (1 - exp(20.0e0)))))), 6) AS bedroc,
  round(hits / greatest(scored, 1) * 1000.0e0, 6) AS per_1000, round(shared / full_n, 6) AS overlap, round(alert_free, 6) AS alert_free, groups FROM c"""


_CELL_VALUES = ("realized", "retention", "bedroc", "per_1000", "overlap", "alert_free")


def _pulls(s):
    return s.o.where(E.hash_order("item_id", 1, "lab") < F.lit("1")).groupBy("target", "part_id").agg(F.count("*").alias("pulls"))


@query("budget_cells", "o", _cells(PR.RATIOS, PR.ROUTES))
def _(s):
    """Six budgets by five routes, each ranked by the same fusion."""
    return rounded(PR.budget_cells(s.o, _pulls(s)), *_CELL_VALUES)


@query("allocation_control", "o", _cells((0.1,), PR.ROUTES[:4]))
def _(s):
    """Four routes under one budget."""
    return rounded(PR.budget_cells(s.o, _pulls(s), (0.1,), PR.ROUTES[:4]), *_CELL_VALUES)


@query("topk_overlap", "o", f"""WITH a AS (SELECT item_id, target FROM o QUALIFY row_number() OVER (PARTITION BY target ORDER BY mu DESC, item_id) <= 100), b AS (SELECT item_id, target FROM o QUALIFY row_number() OVER (PARTITION BY target ORDER BY mu - 0.1e0 * u_conf DESC, item_id) <= 100)
SELECT target, count(*) AS overlap FROM a JOIN b USING (item_id, target) GROUP BY target""")
def _(s):
    a = R.top_per(s.o, F.col("mu").desc(), 100).select("item_id", "target")
    b = R.top_per(s.o, (F.col("mu") - F.lit(0.1) * F.col("u_conf")).desc(), 100).select("item_id", "target")
    return a.join(b, ["item_id", "target"]).groupBy("target").agg(F.count("*").alias("overlap"))
