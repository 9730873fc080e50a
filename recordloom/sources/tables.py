"""Scans: strict TSV, splits of several sources, truth lists, Parquet by ids, lists with any separator, merged parts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from recordloom.functions.ids import encode_id
from recordloom.functions.text import split_ids

RECORD_COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")


def strings(*names: str) -> StructType:
    return StructType([StructField(n, StringType()) for n in names])


def read_tsv(spark: SparkSession, path, columns: tuple[str, ...] = RECORD_COLUMNS, empty: str | None = "", limit: int | None = None) -> DataFrame:
    """Tab separated, no quoting, no type inference. Empty cells become `empty` (None keeps null); limit: only so many rows,
    whichever come first."""
    rows = spark.read.schema(strings(*columns)).option("sep", "\t").option("header", True).option("quote", "").option("enforceSchema", False).csv(path)
    rows = rows if limit is None else rows.limit(limit)
    return rows if empty is None else rows.fillna(empty)


def read_tsv_checked(spark: SparkSession, path, columns: tuple[str, ...] = RECORD_COLUMNS, header: bool = True) -> DataFrame:
    """As read_tsv, but lines that don't fit are kept in `bad_line`: so all columns are parsed, whichever are asked for."""
    schema = StructType([*strings(*columns), StructField("bad_line", StringType())])
    options = {"sep": "\t", "header": header, "quote": "", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line", "columnPruning": False}
    return spark.read.schema(schema).options(**options).csv(path)


def unify(sources: dict[int, DataFrame]) -> DataFrame:
    """Source tables as one: id, src, name, addr, country."""
    parts = [
        d.select(encode_id(F.col("entity_id")).alias("id"), F.lit(src).cast("byte").alias("src"), F.col("business_name").alias("name"), F.col("business_address").alias("addr"), "country")
        for src, d in sorted(sources.items())
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def load_split(spark: SparkSession, folder: str, split: str, sources: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    return unify({s: read_tsv(spark, f"{folder}/{split}/{split}_source{s}.tsv") for s in sources})


def truth_pairs(truth: DataFrame) -> DataFrame:
    """(s1, rec) for each listed id; rec -1 for an entity without matches."""
    rows = truth.select(encode_id(F.col(TRUTH_COLUMNS[0])).alias("s1"), F.explode_outer(split_ids(F.col(TRUTH_COLUMNS[1]))).alias("_id"))
    return rows.select("s1", F.coalesce(encode_id(F.col("_id")), F.lit(-1)).cast("long").alias("rec"))


def load_truth(spark: SparkSession, path: str) -> DataFrame:
    return truth_pairs(read_tsv(spark, path, TRUTH_COLUMNS))


def by_ids(table: DataFrame, ids: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """Rows whose key is among ids: a semi join, so Spark may push a filter of the ids into the scan."""
    rows = table.select(*dict.fromkeys([key, *columns])) if columns else table
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def sampled_candidates(spark: SparkSession, path: str, share: float, salt: str = "sample") -> DataFrame:
    """A table of candidates (s1, rec, ...), a hash-chosen share of the entities with all their candidates, and the source."""
    from recordloom.functions.ids import hash_part, source_of

    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    return rows.where(hash_part(F.col("s1"), salt, 10_000) < int(share * 10_000)).withColumn("src", source_of(F.col("rec")))


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table: a count without columns reads the files' footers only."""
    return spark.read.parquet(path).count()


def split_files(spark: SparkSession, folder: str, pattern: str = r"^(\w+)_source(\d)\.tsv$") -> DataFrame:
    """(split, source, path) of the files or folders below folder/* whose name fits."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/*/*")
    found = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(fs_path) or []
    rows = [(m.group(1), int(m.group(2)), str(f.getPath())) for f in found if (m := re.match(pattern, f.getPath().getName()))]
    return spark.createDataFrame(rows, "split string, source int, path string")


def best_of_parts(spark: SparkSession, path: str, keys: list[str], score: str, fmt: str = "parquet") -> DataFrame:
    """All files under path, one row per key: the best score, ties by the other columns."""
    rows = spark.read.format(fmt).option("recursiveFileLookup", True).load(path)
    return best_per_key(rows, keys, score)


def best_per_key(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys and c != score]
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *rest)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_column_ids(rows: DataFrame) -> DataFrame:
    return rows.select(F.col(rows.columns[0]).alias("id")).distinct()


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    """word, count of a two-column TSV; a cut-off last line (no count) is ignored."""
    rows = spark.read.schema("word string, count long").option("sep", "\t").option("quote", "").csv(path)
    return rows.where("count IS NOT NULL")


def require_columns(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    if tuple(df.columns) != tuple(columns):
        raise ValueError(f"columns are {df.columns}, not {list(columns)}")
    return df


def pick_column(df: DataFrame, *names: str) -> str | None:
    """The first column of a wanted name, else the first whose name holds one."""
    low = {c.lower(): c for c in df.columns}
    return next((low[n] for n in names if n in low), None) or next((c for n in names for k, c in low.items() if n in k), None)


def dev_slice(records: DataFrame, truth: DataFrame, share: float, salt: str = "slice") -> DataFrame:
    """A share of the reference records, all records that belong to them, and the same share of records nobody claims:
    as dense in matches and decoys as the whole."""
    from recordloom.functions.ids import hash_part

    picked = hash_part(F.col("id"), salt, 10_000) < int(share * 10_000)
    s1 = records.where((F.col("src") == 1) & picked)
    true = truth.where("rec >= 0")
    theirs = true.join(s1.select(F.col("id").alias("s1")), "s1", "left_semi").select(F.col("rec").alias("id"))
    others = records.where(F.col("src") > 1)
    free = others.join(true.select(F.col("rec").alias("id")), "id", "left_anti").where(picked)
    return s1.unionByName(others.join(theirs, "id", "left_semi").select(*s1.columns)).unionByName(free.select(*s1.columns))
