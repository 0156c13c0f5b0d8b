"""Queries of pairing, listings, references, labels, snapshots and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import lexers
from tessella.operators import provenance as P
from tessella.operators import selection, spans
from tessella.plans.governance import _MAN, _manifest
from tessella.plans.selection import _F, _files
from tessella.scratch import Scratch
from tessella.sources.tables import table


def source_pairing(spark, d):
    """Paths of units met with files of their repo, by the whole path or its only suffix; and file names, most of them by suffix."""
    f = _files(spark, d).select(F.col("repo").alias("scope"), "file_id", F.col("rel").alias("path"))
    base = f.select("scope", F.regexp_extract("path", "([^/]+)$", 1).alias("path"))
    u = table(spark, d, "units").where("repo is not null and relpath is not null").select(F.col("repo").alias("scope"), F.col("relpath").alias("path"))
    return P.pair_by_suffix(u.union(base).distinct(), f)


def pin_vs_disk(spark, d):
    """A pinned listing (python and lean) against one on disk (python and C++, one file in seven changed)."""
    f = _files(spark, d).groupBy("repo", "rel", "ext").agg(F.min("bytes").alias("bytes"), F.min("file_id").alias("file_id"))
    pin = f.where("ext in ('py', 'lean')")
    disk = f.where("ext in ('py', 'cc')").withColumn("bytes", F.col("bytes") + (F.col("file_id") % 7 == 0).cast("int"))
    return P.compare(pin, disk, ["repo", "rel"], "bytes").groupBy("repo", "state").agg(F.count(F.lit(1)).alias("files"))


def renamed_add_dates(spark, d):
    """Add dates through a chain of renames: each file was moved once per path segment."""
    f = _files(spark, d).where("date is not null").groupBy("repo", "rel").agg(F.min("date").alias("date"))
    parts = F.split("rel", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("k"), F.concat(F.col("repo"), F.lit(":"), F.array_join(F.slice(parts, k, F.lit(10_000)), "/"), F.lit("#"), F.col("rel")).alias("path")))
    rows = f.withColumn("s", F.explode(steps)).withColumn("old", F.concat(F.col("repo"), F.lit(":"), F.array_join(F.slice(parts, F.col("s.k") + 1, F.lit(10_000)), "/"), F.lit("#"), F.col("rel")))
    last = F.col("s.k") == F.size(parts)
    log = rows.select(F.when(last, F.col("date")).otherwise("2030-01-01").alias("date"), F.when(last, "A").otherwise("R").alias("status"), F.col("s.path").alias("path"), F.when(~last, F.col("old")).alias("old_path"))
    return P.add_dates(log).groupBy("date").agg(F.count(F.lit(1)).alias("paths"))


def block_owner(spark, d):
    """For each 256 bytes of a repo's stream the smallest span that holds them, files and halves of files taken together."""
    m = _manifest(spark, d)
    half = F.expr("start + (end - start) div 2")
    both = m.select("repo", (F.col("id") * 2).alias("id"), "start", "end").unionByName(m.select("repo", (F.col("id") * 2 + 1).alias("id"), "start", half.alias("end")))
    ends = m.groupBy("repo").agg(F.max("end").alias("total"))
    blocks = ends.select("repo", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, F.lit(256).cast("bigint"))).alias("lo")).withColumn("hi", F.col("lo") + 128)
    return P.smallest_containing(blocks, both, ["repo"], 4096).select("repo", "lo", "ties", "span_id")


def _python(spark, d) -> DataFrame:
    f = table(spark, d, "source_files").where("rel like '%.py' and text is not null").groupBy("file_id", "repo").agg(F.min("text").alias("text")).withColumn("lang", F.lit("python"))
    return Scratch(spark).cut(f, "python")


def reference_resolution(spark, d):
    """Names that Python definitions use: own file, imported, elsewhere in the repo, or unresolved, in this order."""
    f = _python(spark, d)
    t = Scratch(spark).cut(lexers.target_table(f, "file_id", "text", "lang").where("name is not null"), "targets")
    uses = t.select("file_id", F.explode("refs").alias("ref")).distinct().join(f.select("file_id", "repo"), "file_id")
    own = t.select("file_id", F.col("name").alias("ref"), F.lit(True).alias("own")).distinct()
    imported = f.select("file_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^(?:from\s+[\w.]+\s+)?import\s+(\w+)"), F.lit(1))).alias("ref")).distinct().withColumn("imp", F.lit(True))
    repo = t.join(f.select("file_id", "repo"), "file_id").groupBy("repo", F.col("name").alias("ref")).agg(F.count_distinct("file_id").alias("owners"))
    j = uses.join(own, ["file_id", "ref"], "left").join(imported, ["file_id", "ref"], "left").join(repo, ["repo", "ref"], "left")
    how = F.when(F.col("own"), "same-file").when(F.col("imp"), "imported").when(F.col("owners") == 1, "repo").when(F.col("owners") > 1, "ambiguous").otherwise("unresolved")
    return j.groupBy("repo", how.alias("how")).agg(F.count(F.lit(1)).alias("refs"))


def label_audit(spark, d):
    """Labels of orders against what was asked for; every eleventh is missing, every thirteenth double, every seventeenth odd."""
    o = table(spark, d, "assembly_orders").select("order_id").distinct()
    lab = o.where("order_id % 11 <> 0").withColumn("label", F.when(F.col("order_id") % 17 == 0, "maybe").otherwise("clone"))
    lab = lab.unionByName(lab.where("order_id % 13 = 0")).unionByName(spark.createDataFrame([(-1, "clone")], "order_id bigint, label string"))
    return P.audit_labels(o, lab, "order_id", ["clone", "distinct"])


def safe_snapshots(spark, d):
    """Last commit per repo before each cutoff, history taken in order of author stamps."""
    c = table(spark, d, "commits").where("commit_sha is not null").groupBy("commit_sha").agg(F.min("repo").alias("scope"), F.min(F.unix_seconds(F.try_to_timestamp("author_stamp"))).alias("a"), F.max(F.unix_seconds(F.try_to_timestamp("committer_stamp"))).alias("at"))
    w = Window.partitionBy("scope").orderBy("a", "commit_sha")
    rows = c.withColumns({"id": F.shiftright(F.xxhash64("commit_sha"), 3), "position": F.row_number().over(w)})
    rows = Scratch(spark).cut(rows.withColumn("parent", F.lag("id").over(w)), "commits")
    cuts = rows.select("scope").distinct().withColumn("cutoff", F.explode(F.array(*[F.unix_seconds(F.to_timestamp(F.lit(f"{y}-06-30T00:00:00Z"))) for y in (2021, 2023, 2025)])))
    return P.safe_snapshots(rows.select("scope", "id", "parent", "position", "at"), cuts).join(rows.select("id", "commit_sha"), "id").select("scope", "cutoff", "commit_sha")


def keyword_union(spark, d):
    """Names of declarations, parents and modules with the lists they stand in."""
    t = table(spark, d, "definition_parents")
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(F.trim(c), r"^_root_\.", "")), F.lit(""))
    return P.union_with_sources({"decl": t.select(clean("decl").alias("name")), "parent": t.select(clean("parent_decl").alias("name")), "module": t.select(F.trim("module_name").alias("name"))}, "name")


def job_grid(spark, d):
    """Jobs by model size and stream: priority, then model."""
    m = table(spark, d, "cells_meta")
    prio = F.when(F.col("stream_kind") == "full_topo", 0).when(F.col("stream_kind").like("clean%"), 1).otherwise(2)
    return m.groupBy(prio.alias("prio"), "model_name").agg(F.count(F.lit(1)).alias("jobs"), F.sum("chunk_size").alias("chunks"))


def preflight_gate(spark, d):
    """Named checks over the tables; a missing fact fails."""
    files = _files(spark, d).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.count_if(F.col("date").isNull()).alias("undated"), F.count_distinct("repo").alias("repos"))
    c = F.col
    return P.gate({"files": c("files") >= 100, "bytes": c("bytes") >= 100_000, "dates": c("undated") == 0, "repos": c("repos") >= 5}, files)


def gate_rollup(spark, d):
    return P.all_passed(preflight_gate(spark, d))


def closed_replay(spark, d):
    """Two derivations of the size of each repo that must agree: by files and by the spans laid end to end."""
    a = _files(spark, d).groupBy("repo").agg(F.sum("bytes").alias("v"))
    b = _manifest(spark, d).groupBy("repo").agg(F.max("end").alias("v"))
    return P.compare(a, b, ["repo"], "v")


def k2_local_prefix(spark, d):
    """What is left of each file before its end once every other 100 bytes are cut out."""
    f = _files(spark, d).select("file_id", "bytes")
    cuts = f.withColumn("k", F.explode(F.sequence(F.lit(0), F.expr("cast(bytes div 200 as int)")))).select("file_id", (F.col("k") * 200 + 50).cast("bigint").alias("start"), F.least(F.col("k") * 200 + 150, F.col("bytes")).alias("end")).where("start < end")
    kept = spans.complement(spans.merged(cuts, ["file_id"]), f.withColumnRenamed("bytes", "length"), ["file_id"], "length")
    return kept.groupBy("file_id").agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("end") - F.col("start")).alias("kept_bytes"))


def pool_priority(spark, d):
    """Seeded shuffle of the deduplicated pool: the order is that of the hash."""
    pool = selection.exact_dedup(_files(spark, d, sha1=F.sha1("text")).select("repo", "rel", "file_id", "sha1"), "sha1", ["repo", "rel"])
    return pool.select("file_id", selection.priority(20260807, "sha1").alias("h"))


_NAMES = """source_pairing pin_vs_disk renamed_add_dates block_owner reference_resolution label_audit safe_snapshots keyword_union job_grid preflight_gate gate_rollup closed_replay k2_local_prefix pool_priority""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_GATE = f"""WITH {_F}, a AS (SELECT count(*) AS files, sum(bytes) AS bytes, count(*) FILTER (WHERE date IS NULL) AS undated, count(DISTINCT repo) AS repos FROM f),
  g AS (SELECT 'files' AS "check", files >= 100 AS passed FROM a UNION ALL SELECT 'bytes', coalesce(bytes >= 100000, false) FROM a UNION ALL SELECT 'dates', undated = 0 FROM a UNION ALL SELECT 'repos', repos >= 5 FROM a)"""

ORACLE = {
    "source_pairing": f"""WITH {_F}, w AS (SELECT DISTINCT repo AS scope, relpath AS path FROM units WHERE repo IS NOT NULL AND relpath IS NOT NULL UNION SELECT repo, regexp_extract(rel, '([^/]+)$', 1) FROM f),
      j AS (SELECT w.scope, w.path, min(f.file_id) FILTER (WHERE f.rel = w.path) AS same, count(DISTINCT f.file_id) AS n, min(f.file_id) AS one FROM w LEFT JOIN f ON f.repo = w.scope AND (f.rel = w.path OR f.rel LIKE '%/' || w.path) GROUP BY w.scope, w.path)
      SELECT scope, path, CASE WHEN same IS NOT NULL THEN 'exact' WHEN n = 1 THEN 'suffix' WHEN n > 1 THEN 'ambiguous' ELSE 'missing' END AS how, CASE WHEN same IS NOT NULL THEN same WHEN n = 1 THEN one END AS file_id FROM j""",
    "pin_vs_disk": f"""WITH {_F}, x AS (SELECT repo, rel, ext, min(bytes) AS bytes, min(file_id) AS file_id FROM f GROUP BY ALL), p AS (SELECT * FROM x WHERE ext IN ('py', 'lean')), k AS (SELECT repo, rel, bytes + CASE WHEN file_id % 7 = 0 THEN 1 ELSE 0 END AS bytes FROM x WHERE ext IN ('py', 'cc')),
      c AS (SELECT coalesce(p.repo, k.repo) AS repo, CASE WHEN k.repo IS NULL THEN 'missing' WHEN p.repo IS NULL THEN 'extra' WHEN p.bytes = k.bytes THEN 'equal' ELSE 'mismatched' END AS state FROM p FULL JOIN k ON p.repo = k.repo AND p.rel = k.rel) SELECT repo, state, count(*) AS files FROM c GROUP BY repo, state""",
    "renamed_add_dates": f"WITH {_F}, x AS (SELECT repo, rel, min(date) AS date FROM f WHERE date IS NOT NULL GROUP BY repo, rel) SELECT date, cast(sum(len(string_split(rel, '/'))) AS BIGINT) AS paths FROM x GROUP BY date",
    "block_owner": f"""WITH {_MAN}, t AS (SELECT repo, max(e) AS total FROM sp GROUP BY repo), b AS (SELECT repo, unnest(range(0, total, 256)) AS lo FROM t), a AS (SELECT repo, file_id * 2 AS id, s, e FROM sp UNION ALL SELECT repo, file_id * 2 + 1, s, s + (e - s) // 2 FROM sp),
      m AS (SELECT b.repo, b.lo, a.id, e - s AS n, min(e - s) OVER (PARTITION BY b.repo, b.lo) AS least FROM b JOIN a ON a.repo = b.repo AND s <= lo AND lo + 128 <= e), z AS (SELECT repo, lo, count(*) AS ties, min(id) AS id FROM m WHERE n = least GROUP BY repo, lo)
      SELECT b.repo, b.lo, coalesce(ties, 0) AS ties, CASE WHEN ties = 1 THEN id END AS span_id FROM b LEFT JOIN z ON z.repo = b.repo AND z.lo = b.lo""",
    "label_audit": """WITH o AS (SELECT DISTINCT order_id FROM assembly_orders) SELECT order_id, CASE WHEN order_id % 11 = 0 THEN 'missing' WHEN order_id % 13 = 0 THEN 'duplicate' ELSE 'outside-domain' END AS reason FROM o
      WHERE order_id % 11 = 0 OR order_id % 13 = 0 OR order_id % 17 = 0 UNION ALL SELECT -1, 'foreign'""",
    "safe_snapshots": """WITH c AS (SELECT commit_sha, min(repo) AS scope, min(floor(epoch(cast(author_stamp AS TIMESTAMPTZ)))) AS a, max(floor(epoch(cast(committer_stamp AS TIMESTAMPTZ)))) AS z FROM commits GROUP BY commit_sha),
      r AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY a, commit_sha) AS p, max(z) OVER (PARTITION BY scope ORDER BY a, commit_sha ROWS UNBOUNDED PRECEDING) AS latest FROM c), k(cutoff) AS (SELECT cast(epoch(TIMESTAMPTZ '2021-06-30 00:00:00+00') AS BIGINT) UNION ALL SELECT cast(epoch(TIMESTAMPTZ '2023-06-30 00:00:00+00') AS BIGINT) UNION ALL SELECT cast(epoch(TIMESTAMPTZ '2025-06-30 00:00:00+00') AS BIGINT))
      SELECT scope, cutoff, arg_max(commit_sha, p) AS commit_sha FROM r, k WHERE latest <= cutoff GROUP BY scope, cutoff""",
    "keyword_union": r"""WITH c AS (SELECT nullif(trim(regexp_replace(trim(decl), '^_root_\.', '')), '') AS name, 'decl' AS s FROM definition_parents UNION ALL SELECT nullif(trim(regexp_replace(trim(parent_decl), '^_root_\.', '')), ''), 'parent' FROM definition_parents
      UNION ALL SELECT trim(module_name), 'module' FROM definition_parents), u AS (SELECT DISTINCT name, s FROM c WHERE name IS NOT NULL) SELECT name, string_agg(s, '|' ORDER BY s) AS sources FROM u GROUP BY name""",
    "job_grid": "SELECT CASE WHEN stream_kind = 'full_topo' THEN 0 WHEN stream_kind LIKE 'clean%' THEN 1 ELSE 2 END AS prio, model_name, count(*) AS jobs, cast(sum(chunk_size) AS BIGINT) AS chunks FROM cells_meta GROUP BY 1, 2",
    "preflight_gate": f"{_GATE} SELECT * FROM g",
    "gate_rollup": f"{_GATE} SELECT bool_and(passed) AS complete, count(*) FILTER (WHERE NOT passed) AS failures FROM g",
    "closed_replay": f"WITH {_F} SELECT DISTINCT repo, 'equal' AS state FROM f",
    "k2_local_prefix": f"""WITH {_F}, k AS (SELECT file_id, bytes, unnest(range(0, bytes // 200 + 1)) AS k FROM f), c AS (SELECT file_id, bytes, k * 200 + 50 AS s, least(k * 200 + 150, bytes) AS e FROM k), g AS (SELECT * FROM c WHERE s < e),
      l AS (SELECT file_id, bytes, coalesce(lag(e) OVER (PARTITION BY file_id ORDER BY s), 0) AS lo, s AS hi FROM g UNION ALL SELECT file_id, max(bytes), max(e), max(bytes) FROM g GROUP BY file_id UNION ALL SELECT file_id, bytes, 0, bytes FROM f WHERE bytes <= 50)
      SELECT file_id, count(*) AS pieces, cast(sum(hi - lo) AS BIGINT) AS kept_bytes FROM l WHERE lo < hi GROUP BY file_id""",
    "pool_priority": f"""WITH {_F}, p AS (SELECT sha1(text) AS sha, arg_min(file_id, {{'a': repo, 'b': rel, 'c': file_id}}) AS file_id FROM f GROUP BY sha1(text)) SELECT file_id, sha256('20260807:' || sha) AS h FROM p""",
}
