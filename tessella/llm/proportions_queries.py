"""Queries of problem 1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.joins import lookup_join
from tessella.llm.proportions import ROUNDS, achieved, draw, margin_report, uniform
from tessella.sources.tables import table


#: Margins to which the weights are raked.
MARGINS = ["length", "centrality", "cohort"]


def instant(c: str) -> F.Column:
    """Timestamp of an ISO stamp; without an offset it counts as UTC, unreadable it is null."""
    text = F.trim(F.col(c))
    return F.try_to_timestamp(F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z"))))


def targets(candidates: DataFrame) -> DataFrame:
    """One row per target_id: repo, terciles, first add.

    Of each column the last known value holds, by batch, time and row number.
    A null tercile is taken from the cell label, however that is spelt; the
    cohort in labels is never used. Rows without target_id are left out.
    """
    label = lambda g: F.regexp_extract(F.upper("cell"), r"L\W?([123])[\W_]*D\W?([123])", g)
    rows = candidates.where("target_id is not null").withColumns({"__l": label(1), "__d": label(2)}).select(
        "target_id",
        F.struct("batch_no", "recorded_at", "row_no").alias("at"),
        "repo",
        "lang",
        F.col("length_tercile").alias("l"),
        F.col("centrality_tercile").alias("d"),
        F.expr("try_cast(nullif(__l, '') as int)").alias("l_label"),
        F.expr("try_cast(nullif(__d, '') as int)").alias("d_label"),
        instant("first_add_utc").alias("added"),
    )
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("at", c)))[c].alias(c)
    one = rows.groupBy("target_id").agg(*[last(c) for c in ("repo", "lang", "l", "d", "l_label", "d_label", "added")])
    return one.select("target_id", "repo", "lang", F.coalesce("l", "l_label").alias("l"), F.coalesce("d", "d_label").alias("d"), "added")


def _plans(plans: DataFrame) -> DataFrame:
    return (
        plans.groupBy("plan_id", "repo", "cell")
        .agg(
            F.max("n_requested").alias("n_requested"),
            F.max("target_bp").alias("share_bp"),
            F.max("min_rows").alias("min_rows"),
        )
        .withColumns({"length": F.substring("cell", 1, 2), "centrality": F.substring("cell", 4, 2), "cohort": F.substring("cell", 7, 10)})
    )


def _drawn(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    plans = table(spark, d, "sample_plans")
    heads = plans.groupBy("plan_id", "repo").agg(F.max(instant("cohort_cutoff")).alias("cutoff"), F.max("sampling_seed").alias("seed"))
    known = targets(table(spark, d, "candidates"))
    members = (
        lookup_join(known, heads, ["repo"], "inner")
        .withColumn("cell", F.concat(F.lit("L"), "l", F.lit("-D"), "d", F.lit("-C"), F.when(F.col("added") > F.col("cutoff"), "post").otherwise("pre")))
        .where("cell is not null")
        .select("plan_id", "cell", "target_id", "repo", uniform("seed", "repo", "target_id").alias("u"))
    )
    return draw(members, _plans(plans), "plan_id", "cell", MARGINS, "target_id", "u")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a plan that could not be filled."""
    return _drawn(spark, d)[1].where("gap > 0").select("plan_id", "cell")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn targets of each plan with their true cell."""
    return _drawn(spark, d)[0].select("plan_id", "cell", "target_id")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Each cell of each plan: what was needed, there, drawn under the raked weights, drawn in the end and missing; target and achieved share."""
    report = _drawn(spark, d)[1].withColumn("achieved_bp", achieved("drawn", "plan_id"))
    return report.select("plan_id", "cell", "share_bp", "min_rows", "needed", "available", "first_drawn", "drawn", "gap", "achieved_bp")


def p1_margins(spark: SparkSession, d: str) -> DataFrame:
    """Target, achieved and residual share of each category of each margin of each plan."""
    return margin_report(_drawn(spark, d)[1], "plan_id", MARGINS)


QUERIES = {"p1_found": p1_found, "p1_sample": p1_sample, "p1_report": p1_report, "p1_margins": p1_margins}

# raking runs in the SQL too: one margin a step, ROUNDS times all of them
_CELLS = rf"""
rows AS (SELECT *, try_cast(nullif(regexp_extract(upper(cell), 'L\W?([123])[\W_]*D\W?([123])', 1), '') AS INT) AS ll,
    try_cast(nullif(regexp_extract(upper(cell), 'L\W?([123])[\W_]*D\W?([123])', 2), '') AS INT) AS dl FROM candidates),
t AS (SELECT target_id, max(repo) AS repo, coalesce(max(length_tercile), max(ll)) AS l, coalesce(max(centrality_tercile), max(dl)) AS d,
    max(cast(first_add_utc AS TIMESTAMPTZ)) AS added FROM rows GROUP BY target_id),
heads AS (SELECT plan_id, repo, max(cast(cohort_cutoff AS TIMESTAMPTZ)) AS cutoff, max(sampling_seed) AS seed FROM sample_plans GROUP BY plan_id, repo),
m AS (SELECT h.plan_id, 'L' || t.l || '-D' || t.d || '-C' || CASE WHEN t.added > h.cutoff THEN 'post' ELSE 'pre' END AS cell, t.target_id,
    (cast('0x' || substr(sha256(h.seed || ':' || t.repo || ':' || t.target_id), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM t JOIN heads h ON t.repo = h.repo),
avail AS (SELECT plan_id, cell, count(*) AS n FROM m GROUP BY plan_id, cell),
p AS (SELECT *, coalesce((SELECT n FROM avail a WHERE a.plan_id = q.plan_id AND a.cell = q.cell), 0) AS available FROM
    (SELECT plan_id, cell, max(target_bp) AS share_bp, max(min_rows) AS min_rows, max(n_requested) AS n_requested,
    greatest(cast(ceil(max(n_requested) * max(target_bp) / 10000.0) AS BIGINT), cast(max(min_rows) AS BIGINT)) AS needed FROM sample_plans GROUP BY plan_id, cell) q),
ipf AS (SELECT 0 AS k, plan_id, cell, share_bp / 10000.0::DOUBLE AS t, available / nullif(sum(available) OVER (PARTITION BY plan_id), 0)::DOUBLE AS w FROM p
  UNION ALL SELECT k + 1, plan_id, cell, t, w * coalesce(sum(t) OVER g / nullif(sum(w) OVER g, 0), 0) FROM ipf WHERE k < {3 * ROUNDS}
    WINDOW g AS (PARTITION BY plan_id, CASE k % 3 WHEN 0 THEN substr(cell, 1, 2) WHEN 1 THEN substr(cell, 4, 2) ELSE substr(cell, 7) END)),
wt AS (SELECT p.*, coalesce(i.w / nullif(p.available, 0), 0) AS weight FROM p JOIN ipf i ON i.k = {3 * ROUNDS} AND i.plan_id = p.plan_id AND i.cell = p.cell),
keyed AS (SELECT m.*, wt.weight, wt.needed, wt.n_requested, -ln(m.u) / CASE WHEN weight > 0 THEN weight ELSE 1 END AS key FROM m JOIN wt ON m.plan_id = wt.plan_id AND m.cell = wt.cell),
ranked AS (SELECT *, row_number() OVER (PARTITION BY plan_id, cell ORDER BY key, target_id) AS in_cell,
    CASE WHEN weight > 0 THEN row_number() OVER (PARTITION BY plan_id, weight > 0 ORDER BY key, target_id) END AS in_plan FROM keyed),
seats AS (SELECT plan_id, max(n_requested) - sum(least(needed, available)) AS seats FROM p GROUP BY plan_id),
over_ AS (SELECT r.plan_id, r.cell, r.target_id, row_number() OVER (PARTITION BY r.plan_id ORDER BY key, target_id) AS k FROM ranked r WHERE in_plan <= n_requested AND in_cell > needed),
s AS (SELECT plan_id, cell, target_id FROM ranked WHERE in_cell <= needed
  UNION ALL SELECT o.plan_id, o.cell, o.target_id FROM over_ o JOIN seats USING (plan_id) WHERE o.k <= seats.seats),
rep AS (SELECT p.plan_id, p.cell, p.share_bp, p.min_rows, p.needed, cast(p.available AS BIGINT) AS available,
    cast((SELECT count(*) FROM ranked r WHERE r.plan_id = p.plan_id AND r.cell = p.cell AND r.in_plan <= r.n_requested) AS BIGINT) AS first_drawn,
    cast((SELECT count(*) FROM s WHERE s.plan_id = p.plan_id AND s.cell = p.cell) AS BIGINT) AS drawn FROM p)
"""

ORACLE = {
    "p1_found": f"WITH RECURSIVE {_CELLS} SELECT plan_id, cell FROM rep WHERE drawn < needed",
    "p1_sample": f"WITH RECURSIVE {_CELLS} SELECT plan_id, cell, target_id FROM s",
    "p1_report": f"WITH RECURSIVE {_CELLS} SELECT plan_id, cell, share_bp, min_rows, needed, available, first_drawn, drawn, greatest(needed - drawn, 0) AS gap,"
    " cast(drawn * 10000 // nullif(sum(drawn) OVER (PARTITION BY plan_id), 0) AS BIGINT) AS achieved_bp FROM rep",
    "p1_margins": f"WITH RECURSIVE {_CELLS}, e AS (SELECT plan_id, share_bp, first_drawn, drawn, unnest(['length', 'centrality', 'cohort']) AS margin, unnest([substr(cell, 1, 2), substr(cell, 4, 2), substr(cell, 7)]) AS category FROM rep),"
    " g AS (SELECT plan_id, margin, category, cast(sum(share_bp) AS BIGINT) AS target_bp, cast(sum(first_drawn) AS BIGINT) AS first_drawn, cast(sum(drawn) AS BIGINT) AS drawn FROM e GROUP BY ALL)"
    " SELECT *, cast(drawn * 10000 // nullif(sum(drawn) OVER (PARTITION BY plan_id, margin), 0) AS BIGINT) AS achieved_bp,"
    " cast(drawn * 10000 // nullif(sum(drawn) OVER (PARTITION BY plan_id, margin), 0) - target_bp AS BIGINT) AS residual_bp FROM g",
}
