"""Where files come from: pairing, add dates, pins, snapshots; and checks that report violations as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.hierarchy import hierarchy

# Ending of compiled indexes and the size of the command grid.
MATCHED, AMBIGUOUS, MISSING = "matched", "ambiguous", "missing"


def pair_by_suffix(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Each wanted path with the file of the same path, else the only file whose path ends with it.

    ``wanted``: ``scope, path``; ``files``: ``scope, file_id, path``. Suffixes
    at slashes are spread out and joined by equality. ``how`` is exact,
    suffix, ambiguous or missing; only the first two carry a ``file_id``.
    """
    parts = F.split("path", "/")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct((k == 1).alias("exact"), F.array_join(F.slice(parts, k, F.lit(10_000)), "/").alias("tail")))
    ends = files.where("path is not null").select("scope", "file_id", F.explode(tails).alias("t")).select("scope", "file_id", F.col("t.exact").alias("exact"), F.col("t.tail").alias("path"))
    per = ends.groupBy("scope", "path").agg(F.min(F.when(F.col("exact"), F.col("file_id"))).alias("same"), F.count_distinct("file_id").alias("n"), F.min("file_id").alias("any"))
    j = wanted.join(per, ["scope", "path"], "left")
    how = F.when(F.col("same").isNotNull(), "exact").when(F.col("n") == 1, "suffix").when(F.col("n") > 1, AMBIGUOUS).otherwise(MISSING)
    return j.select("scope", "path", how.alias("how"), F.when(F.col("same").isNotNull(), F.col("same")).when(F.col("n") == 1, F.col("any")).alias("file_id"))


def add_dates(log: DataFrame) -> DataFrame:
    """Earliest date a path came to be, through renames: ``path, date``.

    ``log``: ``date, status, path, old_path``; A adds a path, R renames the
    old one, whose date the new one takes over. A path that was renamed from
    several takes the earliest rename. Renames are links of a forest, so
    chains of any length resolve together. Rows without path are left out.
    """
    key = lambda c: F.xxhash64(c)
    adds = log.where("status = 'A' and path is not null").groupBy("path").agg(F.min("date").alias("date"))
    moves = log.where("status = 'R' and path is not null and old_path is not null").groupBy("path").agg(F.min_by("old_path", "date").alias("old_path"), F.min("date").alias("moved"))
    paths = adds.select("path").union(moves.select("path")).union(moves.select("old_path")).distinct()
    nodes = paths.join(moves, "path", "left").select(key("path").alias("id"), key("old_path").alias("parent"), "path", "moved")
    nodes = nodes.withColumn("parent", F.when(F.col("moved").isNotNull(), F.col("parent")))
    tree = hierarchy(nodes.select(F.shiftright("id", 3).alias("id"), F.shiftright("parent", 3).alias("parent")), "id", "parent", with_path=True)
    above = tree.select("id", F.explode(F.coalesce("path", F.array("id"))).alias("a"))
    dated = nodes.join(adds, "path", "left").select(F.shiftright("id", 3).alias("a"), F.least("date", "moved").alias("seen"))
    best = above.join(dated, "a").groupBy("id").agg(F.min("seen").alias("date"))
    return nodes.select("path", F.shiftright("id", 3).alias("id")).join(best, "id").select("path", "date")


def compare(left: DataFrame, right: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full comparison of two listings with unique keys: missing, extra, mismatched or equal."""
    a, b = left.select(*key, F.col(value).alias("__a"), F.lit(True).alias("__la")), right.select(*key, F.col(value).alias("__b"), F.lit(True).alias("__lb"))
    j = a.join(b, key, "full_outer")
    state = F.when(F.col("__lb").isNull(), MISSING).when(F.col("__la").isNull(), "extra").when(F.col("__a").eqNullSafe(F.col("__b")), "equal").otherwise("mismatched")
    return j.select(*key, state.alias("state"))


def audit_labels(expected: DataFrame, labels: DataFrame, key: str, domain: list[str]) -> DataFrame:
    """Labels against what was to be labelled: one row per key that breaks the one-to-one rule, with the reason."""
    have = labels.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(F.col("label").isin(domain), F.lit(False))).alias("bad"))
    j = expected.select(key, F.lit(True).alias("__e")).distinct().join(have, key, "full_outer")
    why = F.when(F.col("__e").isNull(), "foreign").when(F.col("n").isNull(), MISSING).when(F.col("n") > 1, "duplicate").when(F.col("bad") > 0, "outside-domain")
    return j.select(key, why.alias("reason")).where("reason is not null")


def smallest_containing(points: DataFrame, spans: DataFrame, key: list[str], width: int) -> DataFrame:
    """The shortest span that contains [lo, hi); null with ``ties`` > 1 if the shortest is not the only one.

    Spans are spread over blocks of ``width`` bytes and met by the block of
    ``lo``.
    """
    k = F.explode(F.sequence(F.expr(f"start div {width}"), F.expr(f"greatest(end - 1, start) div {width}")))
    cut = spans.withColumn("block", k).select(*key, "block", F.col("id").alias("sid"), "start", "end")
    met = points.withColumn("block", F.expr(f"lo div {width}")).join(cut, [*key, "block"]).where("start <= lo and hi <= end").withColumn("len", F.col("end") - F.col("start"))
    best = met.groupBy(*points.columns).agg(F.min("len").alias("len"))
    some = met.join(best, [*points.columns, "len"]).groupBy(*points.columns).agg(F.count(F.lit(1)).alias("ties"), F.min("sid").alias("sid"))
    return points.join(some, points.columns, "left").select(*points.columns, F.coalesce("ties", F.lit(0).cast("bigint")).alias("ties"), F.when(F.col("ties") == 1, F.col("sid")).alias("span_id"))


def safe_snapshots(commits: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Per scope and cutoff the last main-line commit none of whose ancestors is later than the cutoff.

    ``commits``: ``scope, id, parent, position, at``, one parent each; the
    latest stamp among ancestors comes along the paths of the history.
    """
    tree = hierarchy(commits.select("id", "parent"), "id", "parent", with_path=True)
    latest = tree.select("id", F.explode("path").alias("anc")).join(commits.select(F.col("id").alias("anc"), "at"), "anc").groupBy("id").agg(F.max("at").alias("latest"))
    rows = commits.join(latest, "id").join(cutoffs, "scope").where(F.col("latest") <= F.col("cutoff"))
    return rows.groupBy("scope", "cutoff").agg(F.max_by("id", "position").alias("id"))


def union_with_sources(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """All keys with the sorted list of the tables that hold them."""
    rows = None
    for name, df in tables.items():
        part = df.select(key, F.lit(name).alias("source")).where(F.col(key).isNotNull())
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"))


def gate(checks: dict[str, Column], facts: DataFrame) -> DataFrame:
    """Named checks over one row of facts as rows ``check, passed``; a null outcome fails."""
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in checks.items()]))
    return facts.select(rows.alias("r")).select("r.check", "r.passed")


def all_passed(checks: DataFrame) -> DataFrame:
    return checks.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("complete"), F.count_if(~F.col("passed")).alias("failures"))


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per key, the first in the order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")
