"""Contexts of targets: orders of units, renderings, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.scalars import chunk
from tessella.operators.prefix import running
from tessella.operators.selection import priority

# Byte budgets and the grid of arms.
BUDGETS = (4096, 16384, 65536)
ARMS = ("k2", "k3", "k4")
LATE_ARMS = ("k6", "k7", "k4x")


def random_order(pairs: DataFrame, seed: int) -> DataFrame:
    """Units of each target by descending hash: the lowest stands last, nearest to the target."""
    h = priority(f"k5:{seed}", "target", "unit")
    return pairs.withColumn("h", h).withColumn("position", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("h"), F.desc("unit"))))


def nearest_random(pairs: DataFrame, seed: int, k: int) -> DataFrame:
    """The last k units of the random order, the nearest first; each task keeps its best k before the shuffle."""
    w = Window.partitionBy("target").orderBy("h", "unit")
    return pairs.withColumn("h", priority(f"k5:{seed}", "target", "unit")).withColumn("nearest", F.row_number().over(w)).where(F.col("nearest") <= k)


def ranked_order(scored: DataFrame) -> DataFrame:
    """Units by ascending score, ties by descending hash, then unit: the best stands last."""
    h = priority("k6tie", "target", "unit")
    return scored.withColumn("h", h).withColumn("position", F.row_number().over(Window.partitionBy("target").orderBy("score", F.desc("h"), "unit")))


def rendered(units: DataFrame, target: str, order: list, payload: str, path: str, lang: str) -> DataFrame:
    """Byte spans of the chunks of a target laid end to end; a line feed follows each chunk and belongs to it.

    Rows whose chunk is null (other languages, null payloads) are left out; the
    payload itself is not carried along.
    """
    size = F.octet_length(chunk(payload, path, lang)) + 1
    rows = units.withColumn("size", size.cast("bigint")).where("size is not null").drop(payload)
    return running(rows, [target], order, {"end": F.col("size")}).withColumn("start", F.col("end") - F.col("size"))


def universe(units: DataFrame, targets: DataFrame, scope: str, removed: list[DataFrame]) -> DataFrame:
    """Pairs (target, unit) of one scope without the target itself and what each of ``removed`` (target, unit) holds."""
    out = targets.join(units, scope).where("unit <> target")
    for r in removed:
        out = out.join(r.select("target", "unit").distinct(), ["target", "unit"], "left_anti")
    return out


def removed_mass(removed: dict[str, DataFrame], sizes: DataFrame) -> DataFrame:
    """Units and bytes each reason removes, and those removed for several."""
    rows = None
    for reason, df in removed.items():
        part = df.select("target", "unit", F.lit(reason).alias("reason")).distinct()
        rows = part if rows is None else rows.unionByName(part)
    shared = Window.partitionBy("target", "unit")
    rows = rows.withColumn("reasons", F.count(F.lit(1)).over(shared)).join(sizes, "unit")
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("pairs"), F.sum("size").alias("bytes"), F.count_if(F.col("reasons") > 1).alias("shared"))


def cell_grid(targets: DataFrame, seeds: int = 3) -> DataFrame:
    """All cells of a target: k1, arms by budget, random arms by seed and budget, sensitivity arms."""
    cell = lambda arm, budget, seed: F.struct(F.lit(arm).alias("arm"), F.lit(budget).cast("int").alias("budget"), F.lit(seed).cast("int").alias("seed"))
    cells: list[Column] = [cell("k1", None, None)]
    cells += [cell(a, b, None) for a in (*ARMS, *LATE_ARMS, "k3s", "k4s") for b in BUDGETS]
    cells += [cell("k5", b, s) for b in BUDGETS for s in range(seeds)]
    return targets.withColumn("c", F.explode(F.array(*cells))).select(*targets.columns, "c.arm", "c.budget", "c.seed")
