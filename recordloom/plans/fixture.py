"""Linkage tables made from the star-schema tables by SQL that Spark and DuckDB read alike, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

S1 = """
SELECT p_partkey AS id, 1 AS src,
  concat(p_name, ' K', cast(p_partkey % 211 AS string), 'x', CASE p_partkey % 4 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' Inc.' WHEN 2 THEN ' Pvt Limited' ELSE '' END) AS name,
  concat(cast(p_partkey % 997 AS string), ' ', p_type, ' Street, Ward ', p_brand, ', ', cast(110000 + p_partkey % 503 AS string)) AS addr,
  CASE p_size % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country
FROM part
"""

REC = """
SELECT 20000000000 + p_partkey AS id, 2 AS src,
  CASE p_partkey % 6 WHEN 0 THEN upper(concat(p_name, ' K', cast(p_partkey % 211 AS string), 'x LLC'))
    WHEN 1 THEN concat(p_name, ' Incorporated') WHEN 2 THEN concat(replace(p_name, 'i', 'l'), ' K', cast(p_partkey % 211 AS string), 'x')
    WHEN 3 THEN concat('Trader & Sons dba ', p_name, ' K', cast(p_partkey % 211 AS string), 'x')
    WHEN 4 THEN concat('www.', replace(p_name, ' ', ''), 'k', cast(p_partkey % 211 AS string), 'x.com') ELSE '' END AS name,
  CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN concat('00', cast(p_partkey % 997 AS string), ' ', p_type, ' St, N/A, ', cast(110000 + p_partkey % 503 AS string))
    ELSE concat(cast(p_partkey % 997 AS string), 'b ', p_type, ' Street, Ward ', p_brand) END AS addr,
  CASE p_size % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'India' ELSE 'France' END AS country
FROM part
"""

TRUTH = "SELECT p_partkey AS s1, CASE WHEN p_partkey % 18 = 0 THEN -1 ELSE 20000000000 + p_partkey END AS rec FROM part"

#: Scores of each record against four entities: the right one, and others of the same size class.
SCORED = """
SELECT r.id AS rec, s.id AS s1, cast(2 AS int) AS src, (r.id + s.id) % 3 = 0 AS a_missing,
  cast((s.id * 7919 + r.id * 104729) % 1000 AS double) / 1250 + CASE WHEN s.id = r.id - 20000000000 THEN 0.2 ELSE 0.0 END AS p
FROM (SELECT id, id - 20000000000 AS k FROM rec) r JOIN (SELECT id FROM s1) s ON s.id >= r.k - 1 AND s.id <= r.k + 2
"""

CTES = f"s1 AS ({S1}), rec AS ({REC}), truth AS ({TRUTH}), scored AS ({SCORED})"


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    part.createOrReplaceTempView("part")
    s1, rec, truth = spark.sql(S1), spark.sql(REC), spark.sql(TRUTH)
    # the range join of SCORED as four equi-joins: an offset each
    from pyspark.sql import functions as F

    k = F.explode(F.sequence(F.lit(-1), F.lit(2)))
    right = F.col("rec") - 20000000000
    near = rec.select(F.col("id").alias("rec"), k.alias("_d")).withColumn("s1", right + F.col("_d"))
    near = near.join(s1.select(F.col("id").alias("s1")), "s1", "left_semi")
    scored = near.select(
        "rec", "s1", F.lit(2).alias("src"), ((F.col("rec") + F.col("s1")) % 3 == 0).alias("a_missing"),
        (((F.col("s1") * 7919 + F.col("rec") * 104729) % 1000).cast("double") / 1250 + F.when(F.col("s1") == right, 0.2).otherwise(0.0)).alias("p"),
    )
    return {"part": part, "s1": s1, "rec": rec, "truth": truth, "scored": scored, "records": s1.unionByName(rec)}
