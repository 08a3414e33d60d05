"""Fused rankings of many nested subsets of one pool, without a copy of the pool for each of them.

A cell is a pair of a route and a ratio; a row is scored in a cell from a ratio on, its level on the route, so
that a row holds a level a route and is sorted once for each list, not once a cell. Tasks count along ranges of
an order how many rows of each cell came before; what the ranges before hold is added from their totals. Numbers
of a row's cells are lists in the order of the cells, without those in which it isn't scored. The last cell is
the whole pool, which stands for all cells that score every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.operators.ranking import joined
from budgetsieve.sources.sinks import in_passes, written
from budgetsieve.sources.workers import ship

#: Totals of ranges that are sent to all tasks at a time; more of them take passes over their own ranges.
SENT_ROWS = 2_000_000
#: Totals of a range by list, cell and value.
TOLD = "array<struct<list: int, cell: int, value: bigint, n: bigint>>"


def scored_in(i: Column, ratios: int, cells: int) -> Column:
    """Whether a row (levels, upto) is scored in cell i of so many, the whole pool last."""
    j = F.pmod(i, F.lit(ratios))
    return (i == cells - 1) | ((F.get("levels", ((i - j) / ratios).cast("int")) <= j) & (j < F.col("upto")))


def with_group_sizes(rows: DataFrame, ratios: int, cells: int, keys: Sequence[str], group: str) -> DataFrame:
    """Adds ``sizes``: the scored rows of a row's group in each of its cells."""
    each = [F.count_if(scored_in(F.lit(i), ratios, cells)).alias(f"c{i}") for i in range(cells)]
    sizes = rows.groupBy(*keys, group).agg(*each).select(*keys, group, F.array(*[f"c{i}" for i in range(cells)]).alias("sizes"))
    return joined(rows, sizes, [*keys, group], "inner").withColumn("sizes", F.filter("sizes", lambda _, i: scored_in(i, ratios, cells)))


def _kinds(rows: DataFrame, **more: str) -> str:
    """A schema of which everything may be null."""
    return ", ".join([*(f"`{c}` {kind}" for c, kind in rows.dtypes), *(f"`{c}` {kind}" for c, kind in more.items())])


def _mask(batch: pa.RecordBatch, ratios: int) -> np.ndarray:
    """Rows down, cells across: where a row is scored."""
    n = batch.num_rows
    levels = batch["levels"].flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    j = np.arange(ratios)
    scored = (levels[:, :, None] <= j) & (j < batch["upto"].to_numpy(zero_copy_only=False)[:, None, None])
    return np.hstack([scored.reshape(n, -1), np.ones((n, 1), bool)])


def _fields(schema: pa.Schema) -> list[pa.Field]:
    return [pa.field(f.name, f.type) for f in schema]


def _long(column: pa.Array, none: int = 1 << 62) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(none).to_numpy(zero_copy_only=False)


def _places(t: np.ndarray, cell: np.ndarray, value: np.ndarray, which: int, cells: int, had: dict) -> np.ndarray:
    """How many entries of the same target, cell and value came before each, in this batch and before it."""
    place = np.empty(len(t), np.int64)
    if not len(t):
        return place
    key = t * cells + cell
    order = np.lexsort((value, key))
    k, v = key[order], value[order]
    first = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
    n = np.diff(np.r_[first, len(k)])
    start = np.empty(len(first), np.int64)
    for i, at in enumerate(zip(k[first].tolist(), v[first].tolist())):
        start[i] = had.get((which, *at), 0)
        had[(which, *at)] = int(start[i] + n[i])
    place[order] = np.arange(len(k)) - np.repeat(first - start, n)
    return place


def placed(rows: DataFrame, order: Sequence[Column], lists: dict[str, str | None], ratios: int, cells: int, part: str, tail: dict[int, float] | None = None) -> DataFrame:
    """Rows dealt in ranges of (t, order) and written, with their places by list within range, cell and value.

    lists: names of places, and the column of values: one a row, one a cell (``sizes``), or none. Each range ends
    in a row without an item for each target, with its totals (``told``), and with ``tail`` (alpha over the number
    of a target's rows) the sums of exp(-tail * place) over labels that aren't scored, by cell.
    """
    ship(rows.sparkSession)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("t").asc(), *order]
    cut = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(part, F.spark_partition_id())
    names, carried = list(lists), cut.columns
    schema = _kinds(cut, **dict.fromkeys(names, "array<bigint>"), told=TOLD, tail="array<double>")
    empty = [x for x in carried if x not in ("t", part)]

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        had: dict = {}
        sums: dict[int, np.ndarray] = {}
        left: dict[int, np.ndarray] = {}
        seen, at, kinds = set(), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = kinds or pa.schema([*_fields(batch.schema), *[pa.field(x, pa.list_(pa.int64())) for x in names], pa.field("told", told), pa.field("tail", pa.list_(pa.float64()))])
            at = batch[part][0].as_py()
            mask, t = _mask(batch, ratios), _long(batch["t"])
            seen.update(np.unique(t).tolist())
            row, cell = np.nonzero(mask)
            ends = pa.array(np.r_[0, mask.sum(1).cumsum()].astype(np.int32))
            out = []
            for which, name in enumerate(names):
                column = lists[name]
                value = np.zeros(len(row), np.int64) if column is None else _long(batch[column].flatten()) if column == "sizes" else _long(batch[column])[row]
                out.append(pa.ListArray.from_arrays(ends, pa.array(_places(t[row], cell, value, which, cells, had))))
            if tail is not None:
                label = _long(batch["label"], 0) == 1
                for one in np.unique(t).tolist():
                    own = t == one
                    rest = ~mask[own]
                    base = left.get(one, np.zeros(cells, np.int64))
                    upto = rest.cumsum(0) + base
                    left[one] = upto[-1]
                    hit = label[own]
                    sums[one] = sums.get(one, 0.0) + (np.exp(-tail[one] * upto[hit]) * rest[hit]).sum(0)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in carried], *out, pa.nulls(batch.num_rows, told), pa.nulls(batch.num_rows, pa.list_(pa.float64()))], schema=kinds)
        for one in sorted(seen):
            totals = [{"list": which, "cell": key % cells, "value": value, "n": n} for (which, key, value), n in had.items() if key // cells == one]
            end = dict.fromkeys([*empty, *names]) | {"t": one, part: at, "told": totals, "tail": sums[one].tolist() if tail is not None else None}
            yield pa.RecordBatch.from_pylist([end], kinds)

    told = pa.list_(pa.struct([("list", pa.int32()), ("cell", pa.int32()), ("value", pa.int64()), ("n", pa.int64())]))
    return written(cut.mapInArrow(along, schema), "places")


def offsets(rows: DataFrame, part: str) -> DataFrame:
    """(t, part, list, cell, value, n, before): what precedes a range's rows of a list, cell and value in their target."""
    ends = rows.where("told IS NOT NULL").select("t", part, F.explode("told").alias("r")).select("t", part, "r.*")
    whole = ends.groupBy("t", "list", "cell", "value").agg(F.sum("n").alias("__n"))
    lower = Window.partitionBy("t", "list", "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("t", "list", "cell", "value", F.coalesce(F.sum("__n").over(lower), F.lit(0)).alias("lower"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("t", "list", "cell", "value").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ends.withColumn("__before", before).join(whole, ["t", "list", "cell", "value"]).select("t", part, "list", "cell", "value", "n", (F.col("__before") + F.col("lower")).alias("before"))


class Before:
    """Offsets of ranges as sorted arrays."""

    def __init__(self, table: pa.Table, part: str, cells: int):
        get = lambda c: table[c].to_numpy().astype(np.int64)
        self.cells = cells
        self.values = np.unique(get("value"))
        code = self.code(get("t"), get(part), get("list"), get("cell"), get("value"))
        order = np.argsort(code)
        self.at, self.before = code[order], get("before")[order]

    def code(self, t, part, which, cell, value) -> np.ndarray:
        return (((t << 24 | part) * 4 + which) * self.cells + cell) * max(1, len(self.values)) + np.searchsorted(self.values, value)

    def of(self, t, part, which, cell, value) -> np.ndarray:
        return self.before[np.searchsorted(self.at, self.code(t, part, np.int64(which), cell, value))]


def fused_entries(rows: DataFrame, first: DataFrame, second: DataFrame, score: Callable, lists: dict[str, str | None], ratios: int, cells: int) -> DataFrame:
    """(g, item_id, label, rrf): an entry for each cell in which a row is scored, g = t * cells + cell.

    rows: placed in the ranges ``a`` (one list, ``mu_at``), then in the ranges ``b`` (``lists``); first and second: their offsets.
    """
    spark = rows.sparkSession
    mu = spark.sparkContext.broadcast(Before(first.toArrow(), "a", cells))
    sizes = sorted(second.groupBy("b").count().collect())  # one row a range
    body = rows.where("told IS NULL")
    schema = f"g bigint, {_kinds(body.select('item_id', 'label'))}, rrf double"

    def entries(sent):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                row, cell = np.nonzero(_mask(batch, ratios))
                t, a, b = (_long(batch[c])[row] for c in ("t", "a", "b"))
                at = [_long(batch["mu_at"].flatten()) + mu.value.of(t, a, 0, cell, np.zeros(len(row), np.int64))]
                for which, (name, column) in enumerate(lists.items()):
                    value = _long(batch[column].flatten()) if column == "sizes" else _long(batch[column])[row]
                    at.append(_long(batch[name].flatten()) + sent.value.of(t, b, which, cell, value))
                taken = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(t * cells + cell), batch["item_id"].take(taken), batch["label"].take(taken), pa.array(score(*at))], ["g", "item_id", "label", "rrf"])

        return each

    columns = body.select("t", "a", "b", "item_id", "label", "levels", "upto", "mu_at", *dict.fromkeys([*[c for c in lists.values()], *lists]))
    out = None
    for wanted in in_passes(sizes, SENT_ROWS) or [[]]:
        sent = spark.sparkContext.broadcast(Before(second.where(F.col("b").isin(wanted)).toArrow(), "b", cells))
        part = columns.where(F.col("b").isin(wanted)).mapInArrow(entries(sent), schema)
        out = part if out is None else out.unionByName(part)
    return out


def folded(entries: DataFrame, alpha: dict[int, float], cells: int, k: int) -> DataFrame:
    """Entries in the order of their fusion, in ranges: of each (g, range) its first k places, and a row without one.

    That row has the number n of entries and the sum s of exp(-alpha * place) over labels; places are from 1 here.
    """
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("g").asc(), F.col("rrf").desc(), F.col("item_id").asc()]
    cut = entries.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("g", F.spark_partition_id().alias("part"), "item_id", "label")
    schema = _kinds(cut.select("g", "part", "item_id"), place="bigint", n="bigint", s="double")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[int, int] = {}
        s: dict[int, float] = {}
        kinds, part = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch["part"][0].as_py()
            kinds = kinds or pa.schema([*_fields(batch.schema)[:3], ("place", pa.int64()), ("n", pa.int64()), ("s", pa.float64())])
            g, label = _long(batch["g"]), _long(batch["label"], 0) == 1
            first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            for lo, hi in zip(first, np.r_[first[1:], len(g)]):
                one = int(g[lo])
                had = n.get(one, 0)
                place = np.arange(had + 1, had + hi - lo + 1)
                n[one], s[one] = had + int(hi - lo), s.get(one, 0.0) + float(np.exp(-alpha[one // cells] * place[label[lo:hi]]).sum())
                if had < k:
                    top = min(hi, lo + k - had) - lo
                    cut = batch.slice(lo, top)
                    yield pa.RecordBatch.from_arrays([cut["g"], cut["part"], cut["item_id"], pa.array(place[:top]), pa.nulls(top, pa.int64()), pa.nulls(top, pa.float64())], schema=kinds)
        if kinds is not None:
            yield pa.RecordBatch.from_pylist([{"g": g, "part": part, "item_id": None, "place": None, "n": n[g], "s": s[g]} for g in sorted(n)], kinds)

    return written(cut.mapInArrow(fold, schema), "folded")
