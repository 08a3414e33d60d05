"""The best rows of each key under many scores at once, without a sort of the pool for each of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from budgetsieve.operators import ranking as R
from budgetsieve.operators.lists import key_of
from budgetsieve.sources.sinks import in_passes, small, written
from budgetsieve.sources.workers import ship

#: Candidates whose places are counted in one pass.
SENT_ROWS = 500_000


def top_of(pool: DataFrame, scores: dict[str, Column], k: int, keys: Sequence[str] = R.KEYS, kept: Sequence[str] = ()) -> DataFrame:
    """(kind, keys, item_id, kept, score): the k best rows of each key under each score, ties by item_id; written.

    Tasks read the pool once and hold k rows a key and score, of which the best are taken.
    """
    ship(pool.sparkSession)
    names = list(scores)
    rows = pool.select(key_of(keys).alias("__key"), *keys, "item_id", *kept, *[scores[n].cast("double").alias(f"__s{i}") for i, n in enumerate(names)])
    columns = [*keys, "item_id", *kept]
    kinds = dict(rows.dtypes)
    schema = ", ".join(["kind int", *(f"`{c}` {kinds[c]}" for c in columns), "score double"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], pa.Table] = {}
        lowest: dict[tuple[str, int], float] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            head = pa.table({c: batch[c] for c in columns})
            codes = batch["__key"].dictionary_encode()
            of = codes.indices.to_numpy(zero_copy_only=False)
            values = [batch[f"__s{i}"].fill_null(-np.inf).to_numpy(zero_copy_only=False) for i in range(len(names))]
            for code, key in enumerate(codes.dictionary.to_pylist()):
                own = np.flatnonzero(of == code)
                for i, v in enumerate(values):
                    v = np.where(np.isnan(v[own]), np.inf, v[own])
                    least = lowest.get((key, i), -np.inf)
                    if len(own) > k:
                        least = max(least, np.partition(v, len(v) - k)[len(v) - k])
                    at = own[v >= least]
                    if not len(at):
                        continue
                    # value for the order; the score itself is taken from its column
                    new = head.take(pa.array(at)).append_column("score", batch[f"__s{i}"].take(pa.array(at))).append_column("__v", pa.array(v[v >= least]))
                    both = pa.concat_tables([held[key, i], new]) if (key, i) in held else new
                    held[key, i] = both.sort_by([("__v", "descending"), ("item_id", "ascending")]).slice(0, k).combine_chunks()
                    if held[key, i].num_rows == k:
                        lowest[key, i] = held[key, i]["__v"][k - 1].as_py()
        for (_, i), rows in held.items():
            out = rows.drop_columns(["__v"]).add_column(0, "kind", pa.array(np.full(rows.num_rows, i, np.int32)))
            yield from out.to_batches()

    found = rows.mapInArrow(best, schema)
    place = F.row_number().over(Window.partitionBy("kind", *keys).orderBy(F.col("score").desc(), "item_id"))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("kind") + 1)
    return written(found.withColumn("__place", place).where(F.col("__place") <= k).withColumn("kind", named).drop("__place"), "tops")


def places(pool: DataFrame, wanted: DataFrame, orders: dict[str, Column], keys: Sequence[str] = R.KEYS) -> DataFrame:
    """(keys, item_id, a column for each order): places from 0 of some items (keys, item_id) in the whole pool, nulls last.

    The items of a key are sent to all tasks, which count the pool's rows between them.
    """
    spark = pool.sparkSession
    ship(spark)
    names, key = list(orders), key_of(keys)
    values = [F.coalesce(o.cast("double"), F.lit(float("inf"))).alias(f"__o{i}") for i, o in enumerate(orders.values())]
    rows = pool.select(*keys, "item_id", *values)
    wanted = written(R.joined(rows, wanted.select(*keys, "item_id").distinct(), [*keys, "item_id"], "inner"), "wanted")
    long = F.posexplode(F.array(*[f"__o{i}" for i in range(len(names))])).alias("list", "value")
    nth = F.row_number().over(Window.partitionBy(*keys, "list").orderBy("value", "item_id")) - 1
    at = written(wanted.select(*keys, "item_id", long).withColumn("at", nth), "candidates")

    def counts(sent):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[tuple[str, int], np.ndarray] = {}
            for batch in batches:
                codes = batch["key"].dictionary_encode()
                of, ids = codes.indices.to_numpy(zero_copy_only=False), batch["item_id"].to_numpy(zero_copy_only=False)
                for code, one in enumerate(codes.dictionary.to_pylist()):
                    own = np.flatnonzero(of == code)
                    for i in range(len(names)):
                        v, items = sent.value[one][i]
                        x, y = batch[f"__o{i}"].to_numpy(zero_copy_only=False)[own], ids[own]
                        passed = np.searchsorted(v, x, "right")
                        first = np.searchsorted(v, x, "left")
                        for low in np.unique(first[passed > first]):  # equal values: by item
                            high = np.searchsorted(v, v[low], "right")
                            same = (first == low) & (passed == high)
                            passed[same] = low + np.searchsorted(items[low:high], y[same], "right")
                        n = np.bincount(passed, minlength=len(v) + 1)
                        total[one, i] = total.get((one, i), 0) + n
            for (one, i), n in total.items():
                held = np.flatnonzero(n)
                yield pa.RecordBatch.from_pydict({"key": pa.array([one] * len(held)), "list": pa.array(np.full(len(held), i, np.int32)), "at": pa.array(held.astype(np.int32)), "n": pa.array(n[held].astype(np.int64))})

        return count

    sizes = [tuple(r) for r in wanted.groupBy(key.alias("key")).count().orderBy("key").collect()]  # one row a key
    parts = []
    for some in in_passes(sizes, SENT_ROWS) or [[]]:
        table = at.where(key.isin(some)).select(key.alias("key"), "list", "at", "value", "item_id").toPandas().sort_values(["key", "list", "at"], kind="stable")
        held = {k: [(g["value"].to_numpy(), g["item_id"].to_numpy()) for _, g in own.groupby("list")] for k, own in table.groupby("key")}
        parts.append(rows.where(key.isin(some)).select(key.alias("key"), "item_id", *[f"__o{i}" for i in range(len(names))]).mapInArrow(counts(spark.sparkContext.broadcast(held)), "key string, list int, at int, n bigint"))
    n = parts[0]
    for part in parts[1:]:
        n = n.unionByName(part)
    upto = n.groupBy("key", "list", "at").agg(F.sum("n").alias("n")).withColumn("place", F.sum("n").over(Window.partitionBy("key", "list").orderBy("at")))
    told = R.joined(at.withColumn("key", key), small(upto.drop("n"), "counts"), ["key", "list", "at"]).withColumn("place", F.coalesce("place", F.lit(0)))
    return told.groupBy(*keys, "item_id").agg(*[F.max(F.when(F.col("list") == i, F.col("place"))).alias(name) for i, name in enumerate(names)])
