"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.near_duplicates import near_duplicates
from tessella.sources.tables import table

#: Members of a class that meet in one key; a larger class is paired block by block.
BLOCK = 500


def _alike(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return near_duplicates(table(spark, d, "units"), "unit_id", "payload")


def _within(members: DataFrame) -> DataFrame:
    """All pairs x < y of members of one class; pairs of blocks spread a large class over tasks."""
    sized = members.join(members.groupBy("class_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "class_id")
    blocks = sized.withColumn("k", F.ceil(F.col("n") / BLOCK)).withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")))
    left = blocks.select("class_id", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("k") - 1)).alias("j"), F.col("id").alias("x"))
    right = blocks.select("class_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "own")).alias("i"), F.col("own").alias("j"), F.col("id").alias("y"))
    return left.join(right, ["class_id", "i", "j"]).where("i < j or x < y").select("x", "y")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of units that are alike; those of one class (equal word sets) too, all of them whatever its size."""
    members, links = _alike(spark, d)
    a = members.select(F.col("class_id").alias("class_a"), F.col("id").alias("x"))
    b = members.select(F.col("class_id").alias("class_b"), F.col("id").alias("y"))
    across = links.join(a, "class_a").join(b, "class_b").where("x <> y").select("x", "y")
    pairs = across.unionByName(_within(members)).select(F.least("x", "y").alias("unit_id_a"), F.greatest("x", "y").alias("unit_id_b"))
    # a pair comes twice only if a unit has texts of several classes
    several = members.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    return pairs.distinct() if several else pairs


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each unit with its class of equal word sets and the number of other classes it is alike to."""
    members, links = _alike(spark, d)
    both = links.select(F.col("class_a").alias("class_id")).unionAll(links.select("class_b"))
    return members.join(both.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links")), "class_id", "left").select(
        F.col("id").alias("unit_id"), "class_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")
    )


QUERIES = {"p2_found": p2_found, "p2_classes": p2_classes}

# texts without a word are alike only if equal
_SETS = """
w AS (SELECT DISTINCT unit_id, unnest(list_distinct(regexp_extract_all(payload, '[A-Za-z0-9_]+'))) AS w FROM units WHERE unit_id IS NOT NULL),
n AS (SELECT unit_id, count(*) AS n, string_agg(w, ' ' ORDER BY w) AS s FROM w GROUP BY unit_id
  UNION ALL SELECT DISTINCT unit_id, 0, chr(1) || payload FROM units WHERE unit_id IS NOT NULL AND payload IS NOT NULL AND NOT regexp_matches(payload, '[A-Za-z0-9_]'))
"""

ORACLE = {
    "p2_found": f"WITH {_SETS} SELECT a.unit_id AS unit_id_a, b.unit_id AS unit_id_b FROM w a JOIN w b ON a.w = b.w AND a.unit_id < b.unit_id"
    " JOIN n na ON na.unit_id = a.unit_id JOIN n nb ON nb.unit_id = b.unit_id"
    " GROUP BY a.unit_id, b.unit_id, na.n, nb.n HAVING 10 * count(*) >= 7 * (na.n + nb.n - count(*))"
    " UNION SELECT a.unit_id, b.unit_id FROM n a JOIN n b ON a.s = b.s AND a.n = 0 AND b.n = 0 AND a.unit_id < b.unit_id",
    "p2_classes": f"WITH {_SETS}, c AS (SELECT s, min(unit_id) AS class_id, min(n) AS n FROM n GROUP BY s),"
    " p AS (SELECT ca.class_id AS x, cb.class_id AS y FROM c ca JOIN w a ON a.unit_id = ca.class_id JOIN w b ON b.w = a.w JOIN c cb ON cb.class_id = b.unit_id"
    " WHERE ca.class_id <> cb.class_id GROUP BY ca.class_id, cb.class_id, ca.n, cb.n HAVING 10 * count(*) >= 7 * (ca.n + cb.n - count(*)))"
    " SELECT n.unit_id, c.class_id, cast((SELECT count(*) FROM p WHERE p.x = c.class_id) AS BIGINT) AS n_links FROM n JOIN c ON n.s = c.s",
}
