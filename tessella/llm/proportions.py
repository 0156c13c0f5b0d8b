"""Problem 1: a sample that matches target category shares.

Weights come from iterative proportional fitting over several category
margins and ``n_requested`` members are drawn by weighted exponential keys.
Then cells are repaired: a cell below its quota (share or minimum, whichever
is larger) gets its next members, and what was drawn beyond the quotas gives
way, largest keys first, until the sample has its size again. So seats that a
short cell leaves go to the members drawn under the raked weights, which
keeps the margins near their targets. What could not be met is reported per
cell and per margin.

Nothing is sorted as a whole: a quota is found in a histogram of the keys on
a logarithmic scale, and only the rows of the boundary bucket, about a
hundredth of the quota, are ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.joins import lookup_join
from tessella.scratch import Scratch

#: Buckets per doubling of the key.
RESOLUTION = 64
#: Rounds of the proportional fitting over all margins.
ROUNDS = 100


def uniform(*parts) -> F.Column:
    """A number in (0, 1) from the sha256 of the parts, the same on every run."""
    digest = F.sha2(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts]), 256)
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(2**48)


def rake(available: np.ndarray, targets: np.ndarray, margins: list[np.ndarray]) -> np.ndarray:
    """Mass per cell after ROUNDS rounds of proportional fitting to the target of each margin.

    ``margins`` holds for each margin the category number of each cell.
    Categories without an available cell are skipped: their target stays as a
    residual gap.
    """
    mass = available.astype(float)
    if mass.sum() == 0:
        return mass
    mass /= mass.sum()
    for _ in range(ROUNDS):
        for codes in margins:
            now = np.bincount(codes, mass)
            want = np.bincount(codes, targets, minlength=len(now))
            mass = mass * np.divide(want, now, out=np.zeros_like(want), where=now > 0)[codes]
    return mass


def _fit(margins: list[str], cell: str):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cell, kind="stable")
        targets = pdf["share_bp"].to_numpy(float) / 10_000
        codes = [pd.factorize(pdf[m], use_na_sentinel=False)[0] for m in margins]
        available = pdf["available"].to_numpy(float)
        mass = rake(available, targets, codes)
        pdf["fitted"] = mass
        pdf["weight"] = np.divide(mass, available, out=np.zeros_like(mass), where=available > 0)
        return pdf

    return fit


def smallest(df: DataFrame, groups: list[str], key: str, tie: str, quotas: DataFrame) -> DataFrame:
    """The rows with the ``quota`` smallest keys of each group; groups without a quota give none.

    ``quotas`` has one row per group with a bigint ``quota``. Keys must be
    positive. Ties of the key fall to the smaller ``tie``.
    """
    placed = df.withColumn("__b", F.floor(F.log2(F.col(key)) * RESOLUTION))
    hist = placed.groupBy(*groups, "__b").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*groups).orderBy("__b"))
    cut = (
        hist.withColumn("__upto", upto)
        .join(quotas, groups)
        .groupBy(*groups, "quota")
        .agg(
            F.max(F.when(F.col("__upto") <= F.col("quota"), F.col("__b"))).alias("__whole"),
            F.max(F.when(F.col("__upto") <= F.col("quota"), F.col("__upto"))).alias("__had"),
            F.min(F.when(F.col("__upto") > F.col("quota"), F.col("__b"))).alias("__edge"),
        )
        .select(*groups, "__whole", "__edge", (F.col("quota") - F.coalesce("__had", F.lit(0))).alias("__rest"))
    )
    cut = Scratch(df.sparkSession).cut(cut, "cut")
    marked = lookup_join(placed, cut, groups, "inner")
    whole = marked.where(F.col("__b") <= F.col("__whole"))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(key, tie))
    edge = marked.where((F.col("__b") == F.col("__edge")) & (F.col("__rest") > 0)).withColumn("__r", rank).where("__r <= __rest").drop("__r")
    return whole.unionByName(edge).select(df.columns)


def draw(members: DataFrame, plan: DataFrame, group: str, cell: str, margins: list[str], member: str, u: str) -> tuple[DataFrame, DataFrame]:
    """Sample and report.

    ``members``: one row per ``member`` with ``group``, ``cell`` and a uniform
    number ``u``; rows whose group and cell are not in the plan are not drawn.
    ``plan``: one row per group and cell with ``share_bp`` (1/10,000),
    ``min_rows``, ``n_requested`` and the ``margins`` columns; a null margin
    is a category of its own. A null share or minimum counts as 0. Other
    columns are ignored. Sample: ``group, cell, member, u``; it has the larger
    of ``n_requested`` and the sum of the quotas, as far as members with a
    positive weight reach. Report: the named columns of the plan with
    ``available, needed, fitted, weight, first_drawn, drawn, gap``;
    ``first_drawn`` counts the weighted draw before the repair, ``gap`` is
    what the cell lacks. An empty plan gives empty results; empty members give
    a report of gaps only.
    """
    spark = plan.sparkSession
    scratch = Scratch(spark)
    members = members.select(group, cell, member, u)
    plan = plan.select(group, cell, "share_bp", "min_rows", "n_requested", *margins)
    counts = members.groupBy(group, cell).agg(F.count(F.lit(1)).alias("available"))
    frame = (
        plan.withColumns({"share_bp": F.coalesce("share_bp", F.lit(0)), "min_rows": F.coalesce("min_rows", F.lit(0))})
        .join(counts, [group, cell], "left")
        .withColumn("available", F.coalesce("available", F.lit(0).cast("bigint")))
        .withColumn("needed", F.greatest(F.ceil(F.col("n_requested") * F.col("share_bp").cast("bigint") / 10_000), F.col("min_rows").cast("bigint")))
    )
    schema = frame.withColumns({"fitted": F.lit(0.0), "weight": F.lit(0.0)}).schema
    fitted = scratch.cut(frame.groupBy(group).applyInPandas(_fit(margins, cell), schema), "fitted")
    keyed = lookup_join(members, fitted.select(group, cell, "weight"), [group, cell], "inner")
    # a cell that only its minimum asks for has no fitted weight; its keys order it just the same
    keyed = scratch.cut(keyed.withColumn("__key", -F.log(F.col(u)) / F.when(F.col("weight") > 0, F.col("weight")).otherwise(F.lit(1.0))), "keyed")
    totals = fitted.groupBy(group).agg(
        F.max("n_requested").cast("bigint").alias("quota"),
        F.greatest(F.max("n_requested") - F.sum(F.least("needed", "available")), F.lit(0)).cast("bigint").alias("seats"),
    )
    first = scratch.cut(smallest(keyed.where("weight > 0"), [group], "__key", member, totals.select(group, "quota")), "first")
    quotas = fitted.where("needed > 0").select(group, cell, F.col("needed").alias("quota"))
    due = scratch.cut(smallest(keyed, [group, cell], "__key", member, quotas), "due")
    over = first.join(due.select(group, cell, member), [group, cell, member], "left_anti")
    kept = smallest(over, [group], "__key", member, totals.where("seats > 0").select(group, F.col("seats").alias("quota")))
    sample = scratch.cut(due.unionByName(kept).select(members.columns), "sample")
    tally = lambda df, name: df.groupBy(group, cell).agg(F.count(F.lit(1)).alias(name))
    report = (
        fitted.join(tally(first, "first_drawn"), [group, cell], "left")
        .join(tally(sample, "drawn"), [group, cell], "left")
        .withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("first_drawn", "drawn")})
        .withColumn("gap", F.greatest(F.col("needed") - F.col("drawn"), F.lit(0)).cast("bigint"))
    )
    return sample, scratch.cut(report, "report")


def achieved(drawn: F.Column | str, group: str) -> F.Column:
    """Share of the group's sample in whole 1/10,000, rounded down; null for an empty sample."""
    drawn = F.col(drawn) if isinstance(drawn, str) else drawn
    return F.floor(drawn * 10_000 / F.nullif(F.sum(drawn).over(Window.partitionBy(group)), F.lit(0))).cast("bigint")


def margin_report(report: DataFrame, group: str, margins: list[str]) -> DataFrame:
    """Target, achieved and residual share of each category of each margin, from the report of ``draw``.

    Columns: ``group, margin, category, target_bp, first_drawn, drawn,
    achieved_bp, residual_bp``. Shares are rounded down to 1/10,000; those of a
    group without a sample are null.
    """
    named = F.explode(F.array(*[F.struct(F.lit(m).alias("margin"), F.col(m).alias("category")) for m in margins]))
    rows = report.select(group, "share_bp", "first_drawn", "drawn", named.alias("m")).groupBy(group, "m.margin", "m.category")
    sums = rows.agg(F.sum("share_bp").alias("target_bp"), F.sum("first_drawn").alias("first_drawn"), F.sum("drawn").alias("drawn"))
    whole = F.sum("drawn").over(Window.partitionBy(group, "margin"))
    out = sums.withColumn("achieved_bp", F.floor(F.col("drawn") * 10_000 / F.nullif(whole, F.lit(0))).cast("bigint"))
    return out.withColumn("residual_bp", F.col("achieved_bp") - F.col("target_bp"))
