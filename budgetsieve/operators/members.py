"""Member lists of partitions: sorted members in one table, with the place where each partition's list starts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetsieve.operators import ranking as R
from budgetsieve.sources.sinks import written


@dataclass
class MemberLists:
    """members: keys, place, part_id, item_id, where place grows along (part_id, item_id) from 0; offsets: keys, part_id, start, n."""

    members: DataFrame
    offsets: DataFrame
    keys: Sequence[str]

    def slice_of(self, parts: DataFrame, at_most: int | None = None) -> DataFrame:
        """The members of some partitions (keys, part_id), in places; with at_most the first so many of each.

        Places are ranges of the members' table, which is written in their order.
        """
        wanted = R.joined(self.offsets, parts.select(*self.keys, "part_id").distinct(), [*self.keys, "part_id"], "inner")
        taken = F.col("n") if at_most is None else F.least("n", F.lit(at_most))
        spans = wanted.select(*self.keys, "part_id", "start", (F.col("start") + taken).alias("stop"))
        both = R.joined(self.members, spans, [*self.keys, "part_id"], "inner")
        return both.where((F.col("place") >= F.col("start")) & (F.col("place") < F.col("stop"))).drop("start", "stop")


def member_lists(pool: DataFrame, keys: Sequence[str] = R.KEYS) -> MemberLists:
    """Member lists of a pool (keys, part_id, item_id); places are known in ranges, so no partition is gathered."""
    order = [F.col("part_id").asc(), F.col("item_id").asc()]
    members = written(R.range_rank(pool.select(*keys, "part_id", "item_id"), order, "place", keys), "members")
    offsets = members.groupBy(*keys, "part_id").agg(F.min("place").alias("start"), F.count("*").alias("n"))
    return MemberLists(members, written(offsets, "offsets"), list(keys))
