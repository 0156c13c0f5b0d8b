"""Contrasts, variance components, sample sizes, reliability, tiers, corrections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.scratch import Scratch

# T quantiles at 0.975 for 1 to 19 degrees of freedom.
T_0975 = (12.706204736, 4.302652730, 3.182446305, 2.776445105, 2.570581836, 2.446911851, 2.364624252, 2.306004135, 2.262157163, 2.228138852, 2.200985160, 2.178812830, 2.160368656, 2.144786688, 2.131449546, 2.119905299, 2.109815578, 2.100922040, 2.093024054)
Z_0975 = 1.959963984540054
N_MIN, N_MAX, HALF_WIDTH = 200, 400, 0.02


def contrasts(cells: DataFrame, target: list[str], arm: str, value: str, eligible: str, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Differences of two arms per target, only where both are eligible: ``target, contrast, delta``."""
    arms = sorted({a for _, x, y in pairs for a in (x, y)})
    ok = cells.where(F.col(eligible) & F.col(value).isNotNull())
    wide = ok.groupBy(*target).agg(*[F.max(F.when(F.col(arm) == a, F.col(value))).alias(f"v_{a}") for a in arms])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("contrast"), (F.col(f"v_{x}") - F.col(f"v_{y}")).alias("delta")) for n, x, y in pairs]))
    return wide.select(*target, rows.alias("r")).select(*target, "r.contrast", "r.delta").where("delta is not null")


def centred(deltas: DataFrame, family: list[str], value: str, sign: Column) -> DataFrame:
    """sign * (delta - mean - mean of the residuals): families without a level and with a hidden direction."""
    w = Window.partitionBy(*family)
    mean = F.sum(F.col(value).cast("decimal(28,12)")).over(w).cast("double") / F.count(F.lit(1)).over(w)
    rows = deltas.withColumn("__m", mean).withColumn("__r", F.col(value) - F.col("__m"))
    rest = F.sum(F.col("__r").cast("decimal(28,12)")).over(w).cast("double") / F.count(F.lit(1)).over(w)
    return rows.withColumn("published", sign * (F.col("__r") - rest)).drop("__m", "__r")


def variance_components(deltas: DataFrame, family: list[str], module: str, value: str) -> DataFrame:
    """One-way random effects by moments on unequal clusters.

    Mode: insufficient-clusters below two modules or rows; all singletons give
    the sample variance as between part; otherwise moments with the between
    part cut at 0.
    """
    x = F.col(value).cast("decimal(28,12)")
    d = lambda c: c.cast("decimal(28,12)")
    per = deltas.where(F.col(value).isNotNull()).groupBy(*family, module).agg(F.count(F.lit(1)).alias("__m"), F.sum(x).cast("double").alias("__x"), F.sum(d(F.col(value) * F.col(value))).cast("double").alias("__xx"))
    tot = per.groupBy(*family).agg(
        F.sum("__m").alias("n"),
        F.count(F.lit(1)).alias("modules"),
        F.sum(d(F.col("__x"))).cast("double").alias("sum"),
        F.sum(d(F.col("__xx"))).cast("double").alias("sumsq"),
        F.sum(d(F.col("__x") * F.col("__x") / F.col("__m"))).cast("double").alias("between"),
        F.sum(F.col("__m") * F.col("__m")).alias("m2"),
    )
    n, g = F.col("n"), F.col("modules")
    ssw = F.greatest(F.col("sumsq") - F.col("between"), F.lit(0.0))
    ssb = F.greatest(F.col("between") - F.col("sum") * F.col("sum") / n, F.lit(0.0))
    msw = F.try_divide(ssw, n - g)
    msb = F.try_divide(ssb, g - 1)
    n0 = F.try_divide(n - F.col("m2") / n, g - 1)
    mode = F.when((g < 2) | (n < 2), "insufficient-clusters").when(n == g, "all-singleton-conservative").otherwise("mom")
    sample = F.try_divide(F.col("sumsq") - F.col("sum") * F.col("sum") / n, n - 1)
    out = tot.withColumns({"mode": mode, "__w": msw, "__b": msb, "__n0": n0, "__s": sample})
    within = F.when(F.col("mode") == "mom", F.col("__w")).when(F.col("mode") == "all-singleton-conservative", 0.0)
    between = F.when(F.col("mode") == "mom", F.greatest(F.lit(0.0), F.try_divide(F.col("__b") - F.col("__w"), F.col("__n0")))).when(F.col("mode") == "all-singleton-conservative", F.col("__s"))
    return out.select(*family, "n", "modules", "mode", within.alias("sigma_w2"), between.alias("sigma_b2"))


def t_quantile(df: Column) -> Column:
    """t at 0.975 for a pilot of at most 20 targets; null outside of the table."""
    inside = df.between(1, len(T_0975))
    return F.when(inside, F.try_element_at(F.array(*map(F.lit, T_0975)), F.when(inside, df).otherwise(F.lit(1)).cast("int")))


def t_terms() -> tuple[float, ...]:
    """Coefficients of 1 / df, 1 / df**2 and so on in the expansion of t at 0.975."""
    z = Z_0975
    return (
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    )


def t_quantile_any(df: Column) -> Column:
    """t at 0.975 for any whole df from 1: the table, beyond it the expansion in 1 / df about the normal quantile (within 1e-6 there); null below 1."""
    beyond = F.lit(Z_0975)
    for i, c in enumerate(t_terms(), 1):
        beyond = beyond + F.try_divide(F.lit(c), F.pow(df.cast("double"), F.lit(float(i))))
    return F.when(df > len(T_0975), beyond).otherwise(t_quantile(df))


def half_width(between: Column, within: Column, m2: Column, n: Column, df: Column) -> Column:
    return t_quantile(df) * F.sqrt(between * m2 / (n * n) + within / n)


def pearson_or_zero(rows: DataFrame, group: list[str], x: str, y: str) -> DataFrame:
    """Correlation within -1..1; 0 if either side doesn't vary; from moments, so a constant never fails.

    Moments are exact: whole numbers for integral columns, decimals otherwise.
    """
    whole = all(rows.schema[c].dataType.typeName() in ("byte", "short", "integer", "long") for c in (x, y))
    kind = "bigint" if whole else "double"
    d = (lambda c: c) if whole else (lambda c: c.cast("decimal(30,12)"))
    a, b = F.col(x).cast(kind), F.col(y).cast(kind)
    s = rows.where(a.isNotNull() & b.isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(d(v)).cast("double").alias(k) for k, v in (("a", a), ("b", b), ("aa", a * a), ("bb", b * b), ("ab", a * b))]
    )
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    cov = F.col("ab") - F.col("a") * F.col("b") / F.col("n")
    r = F.when((va <= 1e-9) | (vb <= 1e-9), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(F.greatest(va * vb, F.lit(1e-300))))))
    return s.select(*group, "n", r.alias("r"))


def spearman_brown(r: Column) -> Column:
    return F.when(r <= 0, 0.0).otherwise(F.least(F.lit(1.0), 2 * r / (1 + r)))


def split_half(draws: DataFrame, group: list[str], target: str, draw: str, passed: str, n: int, resplits: int, seed: str) -> DataFrame:
    """Per group the median, least and largest corrected half-split reliability over seeded resplits.

    Of each target the n draws of lowest seeded hash are taken, the first half
    against the second. A target has a few dozen draws by protocol; they stay
    in one row, so resplits multiply targets, not draws, and nothing but the
    rates is shuffled.
    """
    parts = int(draws.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = draws.groupBy(*group, target).agg(F.collect_list(F.struct(F.col(draw).alias("d"), F.col(passed).cast("int").alias("p"))).alias("draws")).repartition(parts, *group, target)
    # what is hashed before the draw is made once per resplit
    salts = F.transform(F.sequence(F.lit(0), F.lit(resplits - 1)), lambda k: F.struct(k.alias("k"), F.concat_ws(":", F.lit(seed), *group, F.lit(str(n)), k.cast("string"), F.col(target).cast("string"), F.lit("")).alias("head")))
    rows = own.withColumn("__s", F.explode(salts)).withColumn("resplit", F.col("__s.k"))
    ranked = F.sort_array(F.transform("draws", lambda x: F.struct(F.sha2(F.concat(F.col("__s.head"), x["d"].cast("string")), 256).alias("h"), x["d"].alias("d"), x["p"].alias("p"))))
    half = n // 2
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("l"), F.lit(0).alias("r"))
    step = lambda acc, x: F.struct((acc["i"] + 1).alias("i"), (acc["l"] + F.when(acc["i"] < half, x["p"]).otherwise(0)).alias("l"), (acc["r"] + F.when(acc["i"] >= half, x["p"]).otherwise(0)).alias("r"))
    sums = F.aggregate(F.slice(ranked, 1, n), start, step)  # one pass, so that the ranks are made once
    # passes instead of rates: the correlation is the same
    rate = rows.select(*group, "resplit", target, sums.alias("s")).select(*group, "resplit", target, F.col("s.l").alias("left"), F.col("s.r").alias("right"))
    rate = Scratch(draws.sparkSession).cut(rate, "halves")  # else each moment ranks the draws again
    rel = pearson_or_zero(rate, [*group, "resplit"], "left", "right").withColumn("c", F.round(spearman_brown(F.col("r")), 9))
    return rel.groupBy(*group).agg(F.max("n").alias("n_targets"), F.median("c").alias("median"), F.min("c").alias("least"), F.max("c").alias("largest"))


def tier(passes: Column, trials: Column) -> Column:
    """Whole-number thresholds: below 5 % move up, above 95 % move down, equality stays."""
    return F.when(passes * 100 < trials * 5, "move-up-one").when(passes * 100 > trials * 95, "move-down-one").otherwise("stay")


def holm(rows: DataFrame, family: list[str], p: str, key: str) -> DataFrame:
    """Step-down corrected p values: running maximum of (m - rank + 1) p, at most 1."""
    w = Window.partitionBy(*family)
    r = F.row_number().over(w.orderBy(p, key))
    raw = F.col(p) * (F.count(F.lit(1)).over(w) - r + 1)
    return rows.withColumn("__s", raw).withColumn("p_holm", F.least(F.lit(1.0), F.max("__s").over(w.orderBy(p, key).rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")


def pass_at(k: int, n: Column, c: Column) -> Column:
    """Chance that k of n draws without replacement hold a passing one, given c passes."""
    miss = F.lit(1.0)
    for i in range(k):
        miss = miss * F.greatest(n - c - i, F.lit(0)) / (n - i)
    return F.when(n >= k, 1 - miss)


def isotonic3(a: Column, b: Column, c: Column) -> list[Column]:
    """Non-increasing least-squares fit of three values in order, by pooling neighbours."""
    ab, bc, abc = (a + b) / 2, (b + c) / 2, (a + b + c) / 3
    ok = (a >= b) & (b >= c)
    left = (a < b) & (ab >= c)  # pool a and b
    right = (b < c) & (a >= bc)
    f1 = F.when(ok, a).when(left, ab).when(right, a).otherwise(abc)
    f2 = F.when(ok, b).when(left, ab).when(right, bc).otherwise(abc)
    f3 = F.when(ok, c).when(left, c).when(right, bc).otherwise(abc)
    return [f1, f2, f3]


def upper_bound(deltas: DataFrame, family: list[str], value: str) -> DataFrame:
    """Mean, standard error and the upper end of mean + t(0.975, n - 1) * error; null below two values."""
    x = F.col(value)
    d = lambda c: F.sum(c.cast("decimal(28,12)")).cast("double")
    s = deltas.where(x.isNotNull()).groupBy(*family).agg(F.count(F.lit(1)).alias("n"), d(x).alias("__x"), d(x * x).alias("__xx"))
    n = F.col("n")
    var = F.try_divide(F.greatest(F.col("__xx") - F.col("__x") * F.col("__x") / n, F.lit(0.0)), n - 1)
    out = s.withColumns({"mean": F.col("__x") / n, "error": F.sqrt(var / n)})
    return out.withColumn("upper", F.col("mean") + t_quantile_any(n - 1) * F.col("error")).drop("__x", "__xx")


def signed_rank(deltas: DataFrame, family: list[str], value: str) -> DataFrame:
    """Signed-rank statistics: sums of the average ranks of positive and negative differences; zeros are left out."""
    rows = deltas.where(F.col(value) != 0).withColumn("__a", F.abs(F.col(value)))
    ranked = rows.withColumn("__r", average_rank(rows, family, "__a"))
    up = F.sum(F.when(F.col(value) > 0, F.col("__r")).otherwise(0.0))
    total = F.sum("__r")
    n = F.count(F.lit(1))
    z = F.try_divide(up - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0))
    return ranked.groupBy(*family).agg(n.alias("n"), up.alias("w_plus"), (total - up).alias("w_minus"), z.alias("z"))


def average_rank(rows: DataFrame, group: list[str], value: str) -> Column:
    """Rank with ties averaged, as a window expression."""
    w = Window.partitionBy(*group)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*group, value)) - 1) / 2

