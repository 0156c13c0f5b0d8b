"""Queries of payloads, renderings, orders of units, lexing and source spans over units and source_files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import generated, lean_source, lexers, scalars
from tessella.operators import assembly as A
from tessella.scratch import Scratch
from tessella.sources.tables import table


def _units(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "units").where("unit_id is not null and payload is not null")
    one = u.groupBy("unit_id").agg(F.min(F.struct("relpath", "repo", "lang", "payload")).alias("r")).select("unit_id", "r.relpath", "r.repo", "r.lang", "r.payload")
    return one


def payload_normalization(spark, d):
    """Line feeds removed or added at the end of each payload."""
    p = F.regexp_extract("payload", r"(\n*)\z", 1)
    n = F.length(p)
    return _units(spark, d).select("unit_id", F.greatest(n - 1, F.lit(0)).alias("removed"), F.when(n == 0, 1).otherwise(0).alias("appended"), F.octet_length(scalars.one_line_feed("payload")).alias("bytes"))


def rendered_chunks(spark, d):
    """All units of a repo and language laid end to end with banners, in path order."""
    u = _units(spark, d).where("repo is not null").withColumn("scope", F.concat_ws("/", "repo", "lang"))
    return A.rendered(u, "scope", ["relpath", "unit_id"], "payload", "relpath", "lang").select("scope", "unit_id", "start", "end")


def identity_keys(spark, d):
    """Canonical identity of each unit."""
    compact = F.regexp_replace("identity", r'("(?:[^"\\]|\\.)*")|\s+', "$1")
    return table(spark, d, "units").groupBy("unit_id").agg(F.min(compact).alias("identity"), F.count_distinct(compact).alias("spellings"))


def _pool(spark, d) -> DataFrame:
    """Targets (every unit with an id divisible by 50) against all other units of their repo that are not of the same file."""
    u = Scratch(spark).cut(_units(spark, d).where("repo is not null").select(F.col("unit_id").alias("unit"), "repo", "relpath", F.octet_length("payload").cast("bigint").alias("size")), "pool")
    t = u.where("unit % 50 = 0").select(F.col("unit").alias("target"), "repo", F.col("relpath").alias("t_path"))
    same = t.join(u, "repo").where("relpath = t_path").select("target", "unit")
    return A.universe(u.select("unit", "repo", "size"), t.select("target", "repo"), "repo", [same])


def random_arm(spark, d):
    """The 50 units nearest to each target in the random arm."""
    return A.nearest_random(_pool(spark, d), 0, 50).select("target", "unit", "nearest")


def removed_mass(spark, d):
    """What is left out of each target's pool and why: same file, or same size."""
    u = Scratch(spark).cut(_units(spark, d).where("repo is not null").select(F.col("unit_id").alias("unit"), "repo", "relpath", F.octet_length("payload").cast("bigint").alias("size")), "pool")
    t = u.where("unit % 50 = 0").select(F.col("unit").alias("target"), "repo", F.col("relpath").alias("t_path"), F.col("size").alias("t_size"))
    pairs = t.join(u, "repo").where("unit <> target")
    return A.removed_mass({"same_file": pairs.where("relpath = t_path"), "same_size": pairs.where("size = t_size")}, u.select("unit", "size"))


def cell_grid(spark, d):
    """Cells that the grid calls for per arm."""
    t = table(spark, d, "assembly_orders").select("target_id").distinct()
    return A.cell_grid(t).groupBy("arm").agg(F.count(F.lit(1)).alias("cells"), F.count_distinct("budget").alias("budgets"))


def empty_arms(spark, d):
    """Targets and arms of the grid without an assembled order."""
    o = table(spark, d, "assembly_orders").select("target_id", "arm").distinct()
    g = A.cell_grid(o.select("target_id").distinct()).select("target_id", "arm").distinct()
    return g.join(o, ["target_id", "arm"], "left_anti").groupBy("arm").agg(F.count(F.lit(1)).alias("empty"))


def typed_records(spark, d):
    """Records of each unit by kind, from the lexer of its language."""
    r = lexers.typed_records(_units(spark, d), "unit_id", "payload", "lang")
    return r.groupBy("unit_id", F.coalesce("kind", F.lit("error")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def source_spans(spark, d):
    """Bytes of each class per unit; classes cover the whole text."""
    s = lexers.span_table(_units(spark, d), "unit_id", "payload", "lang")
    return s.where("error is null").groupBy("unit_id", "cls").agg(F.count(F.lit(1)).alias("spans"), F.sum(F.col("end") - F.col("start")).alias("bytes"))


def span_conservation(spark, d):
    """Units whose spans don't add up to their bytes: none; and those that don't lex."""
    s = lexers.span_table(_units(spark, d), "unit_id", "payload", "lang").groupBy("unit_id").agg(F.coalesce(F.sum(F.col("end") - F.col("start")), F.lit(0)).alias("covered"), F.max("error").alias("error"))
    size = F.octet_length(F.regexp_replace("payload", "\r\n?", "\n"))
    j = _units(spark, d).select("unit_id", size.alias("bytes")).join(s, "unit_id", "left")
    return j.agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("error").isNull() & (F.col("covered") != F.col("bytes"))).alias("violations"))


def python_targets(spark, d):
    """Top-level definitions of Python files with their spans."""
    f = table(spark, d, "source_files").where("rel like '%.py' and text is not null").groupBy("file_id").agg(F.min("text").alias("text")).withColumn("lang", F.lit("python"))
    return lexers.target_table(f, "file_id", "text", "lang").where("name is not null").select("file_id", "name", "kind", "start_byte", "end_byte", "body_byte", "doc_bytes", F.size("refs").alias("n_refs"))


def lean_declarations(spark, d):
    """Declarations of Lean files with kind, scope and the bytes of header and body."""
    f = table(spark, d, "source_files").where("rel like '%.lean' and text is not null").groupBy("file_id").agg(F.min("text").alias("text")).withColumn("lang", F.lit("lean"))
    return lean_source.declaration_table(f, "file_id", "text", "lang").where("kind is not null").drop("error")


def generated_bodies(spark, d):
    """First complete suites of Python units, their text behind the header taken as generated."""
    return generated.suite_table(_units(spark, d).where("lang = 'python'"), "unit_id", "payload")


def assembled_cells(spark, d):
    """Contexts of the assembled orders: the units with the ids of the list, whole (k4) or as their first lines (k3), cut to the budget.

    The first mention of an id counts; ids without a unit are passed over. Per
    order and rendering: bytes, units wholly and partly inside, whether the
    budget is filled.
    """
    o = table(spark, d, "assembly_orders").where("order_id is not null").groupBy("order_id").agg(F.min(F.struct("budget", "unit_order")).alias("r"))
    items = o.select("order_id", F.col("r.budget").alias("budget"), F.posexplode("r.unit_order").alias("pos", "unit_id")).groupBy("order_id", "budget", "unit_id").agg(F.min("pos").alias("pos"))
    u = _units(spark, d).where("lang is not null")
    first = scalars.interface(F.split("payload", "\n")[0], F.col("lang"))
    both = F.array(F.struct(F.lit("k4").alias("rendering"), F.col("payload").alias("body")), F.struct(F.lit("k3").alias("rendering"), first.alias("body")))
    sized = u.select("unit_id", "relpath", "lang", F.explode(both).alias("b")).select("unit_id", F.col("b.rendering").alias("rendering"), (F.octet_length(scalars.chunk(F.col("b.body"), "relpath", "lang")) + 1).cast("bigint").alias("size"))
    rows = items.join(sized, "unit_id")
    w = Window.partitionBy("order_id", "rendering")  # one order's units
    upto = F.sum("size").over(w.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    cut = rows.withColumns({"total": F.sum("size").over(w), "upto": upto})
    inside = F.least(F.col("upto") - F.greatest(F.col("total") - F.col("budget"), F.lit(0)), F.col("size"))
    cut = cut.withColumn("inside", F.greatest(inside, F.lit(0)))
    return cut.groupBy("order_id", "rendering", "budget").agg(
        F.sum("inside").alias("context_bytes"), F.count_if(F.col("inside") == F.col("size")).alias("whole"), F.count_if((F.col("inside") > 0) & (F.col("inside") < F.col("size"))).alias("partial"), (F.max("total") >= F.col("budget")).alias("eligible")
    )


def iso_stamps(spark, d):
    """Stamps of commits as instants; those without an offset are refused."""
    c = table(spark, d, "commits").select("commit_sha", "author_stamp").distinct()
    return c.select("commit_sha", "author_stamp", F.unix_seconds(scalars.instant("author_stamp")).alias("epoch"))


def path_guards(spark, d):
    f = table(spark, d, "source_files").select("file_id", "rel", "module_name").distinct()
    return f.select("file_id", scalars.is_relative_path("rel").alias("safe"), scalars.module_path("module_name", ".x").alias("path"), scalars.package_name("module_name").alias("package"))


def masked_families(spark, d):
    """Opaque ids of (repo, arm) under a salt."""
    o = table(spark, d, "assembly_orders").select("repo", "arm").distinct()
    return o.select("repo", "arm", scalars.masked_id("fam", b"salt", "mask", "repo", "arm").alias("family"))


_NAMES = """payload_normalization rendered_chunks identity_keys random_arm removed_mass cell_grid empty_arms typed_records source_spans span_conservation python_targets lean_declarations generated_bodies assembled_cells iso_stamps
path_guards masked_families""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_U = "p AS (SELECT unit_id, min({'a': relpath, 'b': repo, 'c': lang, 'd': payload}) AS r FROM units WHERE payload IS NOT NULL GROUP BY unit_id), u AS (SELECT unit_id, r.a AS relpath, r.b AS repo, r.c AS lang, r.d AS payload FROM p)"
_N = "regexp_replace(payload, chr(10) || '+$', '') || chr(10)"
_POOL = f"""{_U}, w AS (SELECT unit_id AS unit, repo, relpath, octet_length(encode(payload)) AS size FROM u WHERE repo IS NOT NULL),
  pl AS (SELECT t.unit AS target, w.unit, w.size FROM w t JOIN w ON t.repo = w.repo AND t.unit % 50 = 0 AND w.unit <> t.unit AND w.relpath <> t.relpath)"""

ORACLE = {
    "payload_normalization": f"""WITH {_U}, n AS (SELECT *, length(payload) - length(rtrim(payload, chr(10))) AS n FROM u) SELECT unit_id, cast(greatest(n - 1, 0) AS INT) AS removed, CASE WHEN n = 0 THEN 1 ELSE 0 END AS appended, cast(octet_length(encode({_N})) AS INT) AS bytes FROM n""",
    "rendered_chunks": f"""WITH {_U}, c AS (SELECT repo || '/' || lang AS scope, unit_id, relpath, octet_length(encode(CASE lang WHEN 'lean' THEN '--' WHEN 'python' THEN '#' END || ' ctx: ' || relpath || chr(10) || {_N})) + 1 AS size FROM u WHERE repo IS NOT NULL AND lang IN ('lean', 'python')),
      s AS (SELECT *, cast(sum(size) OVER (PARTITION BY scope ORDER BY relpath, unit_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e FROM c) SELECT scope, unit_id, e - size AS start, e AS "end" FROM s""",
    "identity_keys": r"""WITH c AS (SELECT unit_id, regexp_replace(identity, '("(?:[^"\\]|\\.)*")|\s+', '\1', 'g') AS i FROM units) SELECT unit_id, min(i) AS identity, count(DISTINCT i) AS spellings FROM c GROUP BY unit_id""",
    "random_arm": f"WITH {_POOL}, o AS (SELECT target, unit, row_number() OVER (PARTITION BY target ORDER BY sha256('k5:0:' || target || ':' || unit), unit) AS nearest FROM pl) SELECT target, unit, cast(nearest AS INT) AS nearest FROM o WHERE nearest <= 50",
    "removed_mass": f"""WITH {_U}, w AS (SELECT unit_id AS unit, repo, relpath, octet_length(encode(payload)) AS size FROM u WHERE repo IS NOT NULL), q AS (SELECT t.unit AS target, w.unit, w.size, w.relpath = t.relpath AS f, w.size = t.size AS z FROM w t JOIN w ON t.repo = w.repo AND t.unit % 50 = 0 AND w.unit <> t.unit)
      SELECT 'same_file' AS reason, count(*) AS pairs, cast(sum(size) AS BIGINT) AS bytes, count(*) FILTER (WHERE f AND z) AS shared FROM q WHERE f HAVING count(*) > 0 UNION ALL SELECT 'same_size', count(*), cast(sum(size) AS BIGINT), count(*) FILTER (WHERE f AND z) FROM q WHERE z HAVING count(*) > 0""",
    "cell_grid": """WITH t AS (SELECT count(DISTINCT target_id) AS n FROM assembly_orders), a(arm, cells, budgets) AS (VALUES ('k1', 1, 0), ('k2', 3, 3), ('k3', 3, 3), ('k4', 3, 3), ('k6', 3, 3), ('k7', 3, 3), ('k4x', 3, 3), ('k3s', 3, 3), ('k4s', 3, 3), ('k5', 9, 3))
      SELECT arm, n * cells AS cells, cast(budgets AS BIGINT) AS budgets FROM a, t""",
    "empty_arms": """WITH t AS (SELECT DISTINCT target_id FROM assembly_orders), a(arm) AS (VALUES ('k1'), ('k2'), ('k3'), ('k4'), ('k6'), ('k7'), ('k4x'), ('k3s'), ('k4s'), ('k5')), h AS (SELECT DISTINCT target_id, arm FROM assembly_orders)
      SELECT a.arm, count(*) AS empty FROM t CROSS JOIN a LEFT JOIN h ON h.target_id = t.target_id AND h.arm = a.arm WHERE h.arm IS NULL GROUP BY a.arm""",
    "span_conservation": f"WITH {_U} SELECT count(*) AS units, cast(0 AS BIGINT) AS violations FROM u",
    "assembled_cells": f"""WITH {_U}, o AS (SELECT order_id, min({{'a': budget, 'b': unit_order}}) AS r FROM assembly_orders GROUP BY order_id), i AS (SELECT order_id, r.a AS budget, unnest(r.b) AS unit_id, generate_subscripts(r.b, 1) AS pos FROM o),
      j AS (SELECT order_id, budget, unit_id, min(pos) AS pos FROM i GROUP BY ALL), v AS (SELECT unit_id, relpath, lang, 'k4' AS rendering, payload FROM u WHERE lang IN ('lean', 'python') UNION ALL
        SELECT unit_id, relpath, lang, 'k3', regexp_replace(split_part(payload, chr(10), 1), '[ \t\n\r\f\v]+$', '') || CASE lang WHEN 'python' THEN chr(10) || '    ...' || chr(10) ELSE ' := by omitted' || chr(10) END FROM u WHERE lang IN ('lean', 'python')),
      z AS (SELECT unit_id, rendering, octet_length(encode(CASE lang WHEN 'lean' THEN '--' ELSE '#' END || ' ctx: ' || relpath || chr(10) || {_N})) + 1 AS size FROM v),
      w AS (SELECT j.*, rendering, size, sum(size) OVER (PARTITION BY order_id, rendering) AS total, sum(size) OVER (PARTITION BY order_id, rendering ORDER BY pos ROWS UNBOUNDED PRECEDING) AS upto FROM j JOIN z ON z.unit_id = j.unit_id),
      q AS (SELECT *, greatest(least(upto - greatest(total - budget, 0), size), 0) AS inside FROM w)
      SELECT order_id, rendering, budget, cast(sum(inside) AS BIGINT) AS context_bytes, count(*) FILTER (WHERE inside = size) AS whole, count(*) FILTER (WHERE inside > 0 AND inside < size) AS partial, max(total) >= budget AS eligible FROM q GROUP BY order_id, rendering, budget""",
    "iso_stamps": "SELECT DISTINCT commit_sha, author_stamp, cast(floor(epoch(cast(author_stamp AS TIMESTAMPTZ))) AS BIGINT) AS epoch FROM commits",
    "path_guards": r"""SELECT DISTINCT file_id, coalesce(regexp_full_match(rel, '[^/\\]+(/[^/\\]+)*') AND NOT regexp_matches(rel, '(^|/)\.\.?(/|$)'), false) AS safe,
      CASE WHEN regexp_full_match(module_name, '[^./\\]+(\.[^./\\]+)*') THEN replace(module_name, '.', '/') || '.x' END AS path, lower(regexp_replace(module_name, '[-_.]+', '-', 'g')) AS package FROM source_files""",
}
