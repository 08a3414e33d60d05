"""Readers for item files and result files, with explicit schemas, and a check of stored vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from budgetsieve.functions.expr import norm
from budgetsieve.sources.sinks import small, written


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n, value: non-empty lines with their number from 0 in their file, also where files are read in splits.

    A split's lines are numbered where they are read and shifted by those of the file's earlier splits (a row a split).
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id"))
    lines = written(lines.where(F.trim("value") != ""), "lines")
    splits = lines.groupBy("file", "__block").agg(F.min("__id").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = small(splits.select("file", "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift")), "splits")
    within = F.row_number().over(Window.partitionBy("file", "__block").orderBy("__id")) - 1  # blank lines leave gaps in ids
    placed = lines.withColumn("__at", within)
    return placed.join(shifts, ["file", "__block"]).select("file", (F.col("__at") + F.col("__shift")).alias("n"), "value")


def _parts(spark: SparkSession, path: str) -> DataFrame:
    stem = F.regexp_extract("file", r"([^/]+?)(\.[^./]*)?$", 1)
    return numbered_lines(spark, path).select(F.split(F.trim("value"), r"\s+").alias("parts"), F.concat_ws("_", stem, F.col("n").cast("string")).alias("own"))


def read_ism(spark: SparkSession, path: str, label: int) -> DataFrame:
    """Lines 'string id...': further tokens join to the id with '_'; without one the id is file stem and line number from 0."""
    named = F.when(F.size("parts") > 1, F.array_join(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(1))), "_")).otherwise(F.col("own"))
    return _parts(spark, path).select(F.element_at("parts", 1).alias("smiles"), named.alias("mol_id"), F.lit(label).alias("label"))


def read_smi(spark: SparkSession, path: str, label: int) -> DataFrame:
    """As above, but the id is the second token alone."""
    named = F.coalesce(F.try_element_at("parts", F.lit(2)), F.col("own"))
    return _parts(spark, path).select(F.element_at("parts", 1).alias("smiles"), named.alias("mol_id"), F.lit(label).alias("label"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(n, name): the lines of a list of names, trimmed, in small letters, without blank ones."""
    return numbered_lines(spark, path).select("n", F.lower(F.trim("value")).alias("name"))


def read_existing(spark: SparkSession, paths: Sequence[str], schema: str, strict: bool = True) -> DataFrame:
    """All result files of a list; missing ones are an error, or with strict=False left out, unless none is left."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    exists = lambda p: (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at)
    missing = [p for p in paths if not exists(p)]
    if strict and missing:
        raise FileNotFoundError("missing result files: " + ", ".join(missing))
    there = [p for p in paths if p not in missing]
    if not there:
        raise ValueError("no result file is there")
    return spark.read.schema(schema).csv(there, header=True)


def valid_rows(rows: DataFrame, valid, what: str = "rows") -> DataFrame:
    """Rows that are valid; an error if none is."""
    kept = rows.where(valid)
    if kept.isEmpty():
        raise ValueError(f"no valid {what}")
    return kept


def assert_unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows, which must differ in their keys; an error names one that comes twice."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys).first()
    if twice is not None:
        raise ValueError(f"duplicate rows for {twice.asDict()}")
    return rows


def parse_comparisons(spec: str) -> list[tuple[str, str]]:
    """Pairs of a spec 'method:baseline,method:baseline'."""
    pairs = [tuple(item.strip().split(":", 1)) for item in spec.split(",")]
    if any(len(p) != 2 for p in pairs):
        raise ValueError(f"not of the form a:b,c:d: {spec}")
    return pairs


def read_tsv(spark: SparkSession, path: str, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """A (gzipped) TSV with a header; columns by the first alias there is, whatever its case; blank rows go."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    there = {c.lower(): c for c in raw.columns}
    picked = []
    for name, names in aliases.items():
        found = next((there[a.lower()] for a in names if a.lower() in there), None)
        if found is None:
            raise ValueError(f"no column for {name} among {raw.columns}")
        picked.append(F.trim(F.col(found)).alias(name))
    out = raw.select(*picked)
    for name in aliases:
        out = out.where(F.col(name).isNotNull() & (F.col(name) != ""))
    return out


def read_results(spark: SparkSession, path: str, schema: str, keys: Sequence[str] = ()) -> DataFrame:
    """Result CSVs (a glob too); with keys the first row of each key by file name stays."""
    rows = spark.read.schema(schema).csv(path, header=True)
    if not keys:
        return rows
    order = Window.partitionBy(*keys).orderBy("__file", *[c for c in rows.columns if c not in keys])
    return rows.withColumn("__file", F.input_file_name()).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", "__file")


def read_tagged(spark: SparkSession, specs: Sequence[str], schema: str, keys: Sequence[str] = ()) -> DataFrame:
    """Specs 'SEED:path': all files, with their seed as a column; rows must differ in seed and keys, if these are given."""
    out = None
    for spec in specs:
        seed, path = spec.split(":", 1)
        part = spark.read.schema(schema).csv(path, header=True).withColumn("seed", F.lit(int(seed)))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return assert_unique(out, ["seed", *keys]) if keys else out


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """Non-empty lines of each file."""
    return spark.read.text(path).where(F.trim("value") != "").groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 and size of each file."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"), "length")


def write_vectors(pool: DataFrame, path: str, order: str = "prefix_rank") -> None:
    """Vectors sorted by rank, so that prefixes prune row groups."""
    pool.repartitionByRange(F.col(order)).sortWithinPartitions(order).write.mode("overwrite").parquet(path)


def read_prefix(spark: SparkSession, path: str, size: int, order: str = "prefix_rank") -> DataFrame:
    return spark.read.parquet(path).where(F.col(order) <= size)


def vector_check(vectors: DataFrame, x: str = "x") -> DataFrame:
    """Rows, dimensions, finite rows and mean norm of stored vectors."""
    finite = F.forall(x, lambda v: ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.agg(F.count("*").alias("n_rows"), F.min(F.size(x)).alias("low_dims"), F.max(F.size(x)).alias("high_dims"), F.count_if(finite).alias("n_finite"), F.avg(norm(x)).alias("mean_norm"))
