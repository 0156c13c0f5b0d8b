"""Token rows to groups, bins and context curves."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LN2 = math.log(2)
# Edges are 2**k for k = 0..19; floors and limits of the measurement protocol.
N_BINS = 19
MIN_BIN_WINDOWS = 8
MIN_CELL_WINDOWS = 15
MIN_CELL_DOCS = 30
HOLDOUT_SPLIT = 8192.0
FLAT = (0.05, 0.10)

#: Exact sums of the scores, independent of the order of rows.
SCORE = "decimal(28,8)"


def exact_sum(c: str | Column) -> Column:
    return F.sum((F.col(c) if isinstance(c, str) else c).cast(SCORE)).cast("double")


def clean_tokens(dump: DataFrame) -> DataFrame:
    """Token rows that can be scored: repeats dropped; nll present, finite and not negative; grp present."""
    good = "grp is not null and nll is not null and not isnan(nll) and nll >= 0 and nll < double('infinity')"
    return dump.distinct().where(good)


def collapse(tokens: DataFrame, keys: Iterable[str] = ("cell_name",)) -> DataFrame:
    """One row per (keys, win, grp): doc and ctxb of the opening token, sums of blen and nll.

    The opener is the token with the smallest (ctxb, tok, doc), so the result
    doesn't depend on the order of rows. ``n_tokens`` and ``n_docs`` tell
    groups whose tokens disagree about the document.
    """
    opener = F.min(F.struct("ctxb", "tok", "doc"))
    return (
        tokens.groupBy(*keys, "win", "grp")
        .agg(opener.alias("o"), F.sum("blen").alias("blen"), exact_sum("nll").alias("nll"), F.count(F.lit(1)).alias("n_tokens"), (F.max("doc") != F.min("doc")).alias("mixed"))
        .select(*keys, "win", "grp", F.col("o.doc").alias("doc"), F.col("o.ctxb").alias("ctxb"), "blen", "nll", "n_tokens", "mixed")
    )


def conservation(tokens: DataFrame, groups: DataFrame, keys: Iterable[str] = ("cell_name",)) -> DataFrame:
    """Bytes and nats before and after the collapse, and the groups that break a rule."""
    keys = list(keys)
    before = tokens.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("blen").alias("bytes_before"), exact_sum("nll").alias("nll_before"))
    after = groups.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum("blen").alias("bytes_after"),
        exact_sum("nll").alias("nll_after"),
        F.count_if("mixed").alias("mixed_groups"),
        F.count_if(F.col("blen") <= 0).alias("zero_byte_groups"),
    )
    return before.join(after, keys)


def binned(groups: DataFrame, scale: float = 1.0) -> DataFrame:
    """Groups with ``bin`` on the edges scale * 2**k; those outside the edges or without bytes are dropped."""
    b = F.floor(F.log2(F.col("ctxb") / F.lit(scale))).cast("int")
    return groups.where((F.col("ctxb") >= scale) & (F.col("ctxb") < scale * 2**N_BINS) & (F.col("blen") > 0)).withColumn("bin", b)


def bin_table(groups: DataFrame, keys: Iterable[str] = ("cell_name",), scale: float = 1.0) -> DataFrame:
    """Per bin: nll, bytes, groups, windows, documents, bits per byte and its median over groups.

    The median is over values rounded to 5 places, which bounds what a task
    holds to the number of distinct values.
    """
    keys = list(keys)
    agg = binned(groups, scale).groupBy(*keys, "bin").agg(
        exact_sum("nll").alias("nll"),
        F.sum("blen").alias("bytes"),
        F.count(F.lit(1)).alias("n_groups"),
        F.count_distinct("win").alias("n_windows"),
        F.count_distinct(F.when(F.col("doc") >= 0, F.col("doc"))).alias("n_docs"),
        F.median(F.round(F.col("nll") / LN2 / F.col("blen"), 5)).alias("bpb_median"),
    )
    mid = F.sqrt(F.pow(F.lit(2.0), F.col("bin")) * F.pow(F.lit(2.0), F.col("bin") + 1)) * scale
    return agg.withColumns({"bpb": F.col("nll") / LN2 / F.col("bytes"), "mid": mid})


def cell_summary(groups: DataFrame, keys: Iterable[str] = ("cell_name",)) -> DataFrame:
    """Overall bits per byte, windows, documents, and whether the cell is large enough to be quantitative."""
    out = groups.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.count_distinct("win").alias("n_windows"),
        F.count_distinct(F.when(F.col("doc") >= 0, F.col("doc"))).alias("n_docs"),
        F.sum("blen").alias("bytes_scored"),
        exact_sum("nll").alias("nll"),
        F.count_if(F.col("doc") < 0).alias("n_unattributed"),
    )
    return out.withColumns(
        {
            "overall_bpb": F.try_divide(F.col("nll") / LN2, F.col("bytes_scored")),
            "quantitative": (F.col("n_windows") >= MIN_CELL_WINDOWS) & (F.col("n_docs") >= MIN_CELL_DOCS),
        }
    )


def unit_pivot(groups: DataFrame, unit: str, keys: Iterable[str] = ("cell_name",), value: str = "nll") -> DataFrame:
    """Sums per unit and bin as columns b0..b18, zero where there is none; units below zero are left out."""
    rows = binned(groups).where(F.col(unit) >= 0)
    total = exact_sum if value == "nll" else F.sum
    wide = rows.groupBy(*keys, unit).agg(*[F.coalesce(total(F.when(F.col("bin") == b, F.col(value))), F.lit(0)).alias(f"b{b}") for b in range(N_BINS)])
    return wide


def valid_bins(bins: DataFrame, floor: int = MIN_BIN_WINDOWS) -> DataFrame:
    return bins.where(F.col("n_windows") >= floor)


def context_gain(bins: DataFrame, keys: Iterable[str] = ("cell_name",), floor: int = MIN_BIN_WINDOWS) -> DataFrame:
    """Bits per byte of the decade [16, 256) minus that of the last valid bin; cells without either are left out."""
    decade = F.col("mid").between(16, 255.999999)
    out = valid_bins(bins, floor).groupBy(*keys).agg(
        (exact_sum(F.when(decade, F.col("nll"))) / LN2 / F.sum(F.when(decade, F.col("bytes")))).alias("low_bpb"),
        F.max_by("bpb", "bin").alias("top_bpb"),
        F.max("bin").alias("top_bin"),
    )
    return out.where("low_bpb is not null").withColumn("context_gain", F.col("low_bpb") - F.col("top_bpb"))


def flattening(bins: DataFrame, keys: Iterable[str] = ("cell_name",), floor: int = MIN_BIN_WINDOWS, eps: Iterable[float] = FLAT) -> DataFrame:
    """Per eps the mid of the earliest valid bin from which on all stay within eps of the last."""
    keys = list(keys)
    whole = Window.partitionBy(*keys)
    tail = whole.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    rows = valid_bins(bins, floor).withColumn("top", F.max_by("bpb", "bin").over(whole)).withColumn("eps", F.explode(F.array(*map(F.lit, eps))))
    tail = Window.partitionBy(*keys, "eps").orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    steady = F.bool_and(F.abs(F.col("bpb") - F.col("top")) <= F.col("eps")).over(tail)
    return rows.withColumn("steady", steady).where("steady").groupBy(*keys, "eps").agg(F.min("mid").alias("c_hat"))


def doc_mask(groups: DataFrame, docs: DataFrame, cutoff: str, drop_flagged: bool = False) -> DataFrame:
    """Groups of documents dated strictly after ``cutoff`` (compared as text), optionally without flagged ones.

    ``docs``: ``doc, date, flag``; undated documents don't pass, a null flag is no flag.
    """
    keep = docs.where(F.col("date") > cutoff)
    if drop_flagged:
        keep = keep.where(~F.coalesce("flag", F.lit(False)))
    return groups.join(keep.select("doc").distinct(), "doc", "left_semi")


def common_support(bins: DataFrame, cells: DataFrame, group: list[str], cell: str, floor: int = MIN_BIN_WINDOWS) -> DataFrame:
    """Gain of each cell over the bins that are valid in every cell of its group (two cells at least)."""
    rows = valid_bins(bins, floor).join(cells, cell)
    size = cells.join(rows.select(cell).distinct(), cell).groupBy(*group).agg(F.count_distinct(cell).alias("n_cells")).where("n_cells >= 2")
    shared = rows.join(size, group).groupBy(*group, "bin", "mid", "n_cells").agg(F.count_distinct(cell).alias("n_in")).where("n_in = n_cells")
    top = shared.groupBy(*group).agg(F.max("bin").alias("top_bin"), F.count(F.lit(1)).alias("n_common_bins"))
    decade = F.col("mid").between(16, 255.999999)
    out = (
        rows.join(shared.select(*group, "bin"), [*group, "bin"])
        .join(top, group)
        .groupBy(*group, cell, "top_bin", "n_common_bins")
        .agg(
            (exact_sum(F.when(decade, F.col("nll"))) / LN2 / F.sum(F.when(decade, F.col("bytes")))).alias("decade_bpb"),
            F.max(F.when(F.col("bin") == F.col("top_bin"), F.col("bpb"))).alias("top_common_bpb"),
        )
    )
    return out.where("decade_bpb is not null").withColumn("gain_common", F.col("decade_bpb") - F.col("top_common_bpb"))


def phase_pairs(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Groups met in both phases with different context: oriented nats and bits per byte (positive: more context helped).

    ``agrees`` tells pairs whose bytes and document are equal; the others break a rule and carry no gain.
    """
    a = base.select(*keys, *[F.col(c).alias(f"{c}_0") for c in ("doc", "ctxb", "blen", "nll")])
    b = other.select(*keys, *[F.col(c).alias(f"{c}_p") for c in ("doc", "ctxb", "blen", "nll")])
    j = a.join(b, keys).where("ctxb_p <> ctxb_0")
    nats = -F.signum((F.col("ctxb_p") - F.col("ctxb_0")).cast("double")) * (F.col("nll_p") - F.col("nll_0"))
    ratio = F.greatest("ctxb_p", "ctxb_0") / F.greatest(F.least("ctxb_p", "ctxb_0"), F.lit(1))
    return j.withColumns(
        {
            "agrees": (F.col("blen_0") == F.col("blen_p")) & (F.col("doc_0") == F.col("doc_p")),
            "nats": nats,
            "bits": F.try_divide(nats / LN2, F.col("blen_0")),
            "stratum": F.rint(F.log2(ratio)).cast("int"),
        }
    )


def phase_gain(pairs: DataFrame, keys: list[str]) -> DataFrame:
    out = pairs.where("agrees").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_distinct(F.when(F.col("doc_0") >= 0, F.col("doc_0"))).alias("n_docs"),
        (exact_sum("nats") / LN2 / F.sum("blen_0")).alias("byte_weighted"),
        (exact_sum("bits") / F.count(F.lit(1))).alias("equal_group"),
        (F.count_if(F.col("bits") > 0) / F.count(F.lit(1))).alias("frac_positive"),
    )
    return out


def fit_support(bins: DataFrame, keys: Iterable[str] = ("cell_name",), floor: int = MIN_BIN_WINDOWS) -> DataFrame:
    """Whether the valid bins are one run and enough for fitting (5 up to the split) and for holding out (2 beyond)."""
    out = valid_bins(bins, floor).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_valid"),
        (F.max("bin") - F.min("bin") + 1 == F.count(F.lit(1))).alias("contiguous"),
        F.count_if(F.col("mid") <= HOLDOUT_SPLIT).alias("n_fit_bins"),
        F.count_if(F.col("mid") > HOLDOUT_SPLIT).alias("n_holdout_bins"),
    )
    return out.withColumn("enough", F.col("contiguous") & (F.col("n_fit_bins") >= 5) & (F.col("n_holdout_bins") >= 2))
