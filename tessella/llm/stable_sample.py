"""Problem 5: a sample that stays as it is while data grow.

Stratified hash thresholds: a record is picked if the salted hash of its key
lies below the threshold of its stratum. Key, salt and stratum of a record
never change and thresholds are only ever raised, so whoever was picked
stays, whatever is added and however the rows are partitioned. One pass,
no sort; the only shuffle finds the first delivery of each record.

Thresholds are kept in a table to which rows are only ever appended
(``set_rates``); the largest rate ever set for a stratum holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.joins import lookup_join

PPM = 1_000_000


def raised(rates: DataFrame, strata: list[str]) -> DataFrame:
    """The threshold of each stratum from all rates ever set for it: the largest, between 0 and PPM.

    ``rates`` has the strata columns and ``rate_ppm``; null rates are skipped.
    """
    return rates.where("rate_ppm is not null").groupBy(*strata).agg(F.least(F.greatest(F.max("rate_ppm"), F.lit(0)), F.lit(PPM)).cast("bigint").alias("rate_ppm"))


def set_rates(spark: SparkSession, path: str, rates: DataFrame) -> DataFrame:
    """Appends rates (strata columns and ``rate_ppm``) to the table of thresholds and returns all rows ever set.

    A lower rate than before has no effect on what ``raised`` gives, so no
    record once picked is dropped.
    """
    rates.write.mode("append").parquet(path)
    return spark.read.schema(rates.schema).parquet(path)


def first_known(rows: DataFrame, key: str, delivery: str, columns: list[str]) -> DataFrame:
    """One row per key; of each column the value of the earliest delivery that has one, of several the least.

    Rows of a later delivery never change a value once there is one. A null
    delivery counts as the earliest; rows with a null key are left out.
    """
    at = F.coalesce(F.col(delivery), F.lit(-(2**31))).alias("at")
    first = [F.min(F.when(F.col(c).isNotNull(), F.struct(at, F.col(c).alias("v"))))["v"].alias(c) for c in columns]
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*first)


def stable_sample(records: DataFrame, strata: list[str], salted_key: F.Column, rates: DataFrame) -> DataFrame:
    """Records whose hash lies below the threshold of their stratum.

    Adds ``key_hash`` (the first 16 hex digits of the sha256 of
    ``salted_key``) and ``rate_ppm``. Records with a null key or stratum, or
    of a stratum without a rate, are not picked. Equal keys are picked or left
    together. Columns of these two names are replaced, others stay. Without
    strata one rate holds for all. An empty input gives an empty sample.
    """
    hashed = records.drop("rate_ppm").withColumn("key_hash", F.substring(F.sha2(salted_key, 256), 1, 16)).where("key_hash is not null")
    if strata:
        placed = lookup_join(hashed, raised(rates, strata), strata, "inner")
    else:
        placed = hashed.withColumn("rate_ppm", F.lit(raised(rates, []).first()["rate_ppm"]).cast("bigint"))
    head = F.conv(F.substring("key_hash", 1, 8), 16, 10).cast("bigint")
    return placed.where(head * PPM < F.col("rate_ppm") * F.lit(2**32))
