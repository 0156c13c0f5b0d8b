"""Queries of selection, strata and provenance over source_files, commits and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import selection as S
from tessella.sources.tables import table

# Seeds and caps of the streams.
SELECT_SEED = 20260808
CAP, BASE_CAP, CLEAN_FLOOR = 40_000, 15_000, 15_000
# Subjects that tell of foreign code.
VENDOR_SUBJECT = r"(?i)\b(vendor|port(ed|ing)?\b|import(ed)? from|copied|migrat(e|ed|ion)|upstream)\b"


def _files(spark: SparkSession, d: str, **of_text) -> DataFrame:
    """One row per file: path, language, bytes of the text with a final line feed, earliest date.

    ``of_text`` names further columns that are computed from text and ext. Of
    several texts the one of least sha256 holds; texts themselves are never
    shuffled, only what is computed from them.
    """
    f = table(spark, d, "source_files").where("text is not null and rel is not null").withColumn("ext", F.lower(F.regexp_extract("rel", r"\.([A-Za-z0-9]+)$", 1)))
    lf = F.when(F.col("text").endswith("\n"), 0).otherwise(1)
    held = F.struct(F.sha2("text", 256).alias("sha256"), (F.octet_length("text") + lf).cast("bigint").alias("bytes"), *[c.alias(n) for n, c in of_text.items()])
    rows = f.select("file_id", "repo", "rel", "ext", "add_date", "provenance_flag", "first_commit", held.alias("t"))
    one = rows.groupBy("file_id", "repo", "rel", "ext").agg(F.min_by("t", "t.sha256").alias("t"), F.min("add_date").alias("date"), F.max("provenance_flag").alias("flag"), F.min("first_commit").alias("first_commit"))
    return one.select("file_id", "repo", "rel", "t.bytes", *[f"t.{n}" for n in of_text], "date", "flag", "first_commit", "ext").withColumn("prio", S.priority(SELECT_SEED, "rel"))


def corpus_scan(spark, d):
    """Files of 64 bytes and more by language."""
    return _files(spark, d).where("bytes >= 64").groupBy("repo", "ext").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def stream_targets(spark, d):
    """Byte targets that all repos can meet: the full one and that of files after the first cutoff."""
    per = _files(spark, d).groupBy("repo").agg(F.sum("bytes").alias("full"), F.coalesce(F.sum(F.when(F.col("date") > "2024-11-12", F.col("bytes"))), F.lit(0).cast("bigint")).alias("clean"))
    return per.agg(F.least(F.lit(CAP).cast("bigint"), F.min("full")).alias("full_target"), F.coalesce(F.min(F.when(F.col("clean") >= CLEAN_FLOOR, F.col("clean"))), F.lit(0).cast("bigint")).alias("clean_target"))


def doc_priority_order(spark, d):
    return _files(spark, d).select("file_id", "repo", "prio")


def _fill(spark, d, cap=CAP, base=None):
    f = _files(spark, d).select("file_id", "repo", "bytes", "prio").withColumn("cap", F.lit(cap))
    return S.greedy_fill(f if base is None else f.join(base, "file_id", "left"), "repo", "file_id", "bytes", "prio", "cap", None if base is None else "base")


def greedy_budget_fill(spark, d):
    return _fill(spark, d).select("repo", "file_id", "bytes", "used")


def xl_nested_fill(spark, d):
    """A small stream first, then the larger one that holds all of it."""
    base = _fill(spark, d, BASE_CAP).select("file_id", F.lit(True).alias("base"))
    return _fill(spark, d, CAP, base).select("repo", "file_id", "bytes", "used")


def stream_manifest_offsets(spark, d):
    """Spans of the files of each repo laid end to end in path order."""
    return S.running_spans(_files(spark, d), ["repo"], ["rel", "file_id"], "bytes").select("repo", "file_id", "start", "end")


def manifest_contiguity(spark, d):
    """Per repo: whether spans start at 0, follow each other and end at the size of the stream."""
    from pyspark.sql import Window

    m = stream_manifest_offsets(spark, d)
    gap = F.col("start") - F.coalesce(F.lag("end").over(Window.partitionBy("repo").orderBy("start", "file_id")), F.lit(0))
    return m.withColumn("gap", gap).groupBy("repo").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("gap") != 0).alias("gaps"), F.max("end").alias("stream_bytes"), (F.count(F.lit(1)) - F.count_distinct("file_id")).alias("repeated_ids"))


def doc_set_hash(spark, d):
    """Hash of a set of files, whatever their order."""
    h = _files(spark, d).select("repo", F.sha2(F.concat_ws(":", F.col("file_id").cast("string"), "prio"), 256).alias("h"))
    return S.set_digest(h, ["repo"], "h").withColumnRenamed("digest", "set_sha256")


def exact_dedup_pool(spark, d):
    return S.exact_dedup(_files(spark, d, sha1=F.sha1("text")).select("repo", "rel", "file_id", "sha1"), "sha1", ["repo", "rel"]).select("sha1", "copies", "file_id")


def holdout_split(spark, d):
    return S.holdout(_files(spark, d), ["ext"], ["prio", "file_id"]).select("ext", "file_id", "position", "held_out")


def stride_thinning(spark, d):
    return S.stride_thin(_files(spark, d), ["ext"], ["prio", "file_id"], "bytes", 20_000).where("kept").select("ext", "file_id", "position", "step")


def clean_leakage(spark, d):
    """Files in a clean stream that are not later than its cutoff, undated ones included."""
    f = _files(spark, d)
    return f.groupBy("repo").agg(F.count_if(F.coalesce(F.col("date") <= "2024-11-12", F.lit(True))).alias("leaks"), F.count(F.lit(1)).alias("files"))


def byte_match_tolerance(spark, d):
    """Per language: how far the chosen streams lie from the target and from each other."""
    got = _fill(spark, d).groupBy("repo").agg(F.max("used").alias("got"))
    a = got.agg(F.count(F.lit(1)).alias("cells"), F.round(F.max(F.abs(F.col("got") - CAP)) / CAP, 6).alias("worst"), F.round((F.max("got") - F.min("got")) / CAP, 6).alias("spread"))
    return a.withColumn("passed", (F.col("cells") >= 2) & (F.col("worst") <= 0.1) & (F.col("spread") <= 0.1))


def _targets(spark, d):
    one = table(spark, d, "candidates").where("target_id is not null").groupBy("target_id").agg(
        F.max("repo").alias("repo"), F.max("lang").alias("lang"), F.max("body_bytes").alias("body_bytes"), F.max("module_in_degree").alias("in_degree"), F.max("first_add_utc").alias("added")
    )
    return one.withColumn("prio", S.priority("v2a", "repo", "target_id"))


def tercile_cutpoints(spark, d):
    return S.tercile_cutpoints(_targets(spark, d), ["repo"], "body_bytes")


def _celled(spark, d):
    t = _targets(spark, d)
    q = S.tercile_cutpoints(t, ["repo"], "body_bytes")
    length = t.join(q, "repo").withColumn("l", S.tercile("body_bytes")).drop("n", "q1", "q2")
    q = S.tercile_cutpoints(t, ["repo"], "in_degree")
    both = length.join(q, "repo").withColumn("c", S.tercile("in_degree")).drop("n", "q1", "q2")
    stamp = F.try_to_timestamp(F.when(F.col("added").rlike(r"(Z|[+-]\d\d:\d\d)$"), F.col("added")))
    cohort = F.when(stamp > F.to_timestamp(F.lit("2024-11-12T23:59:59Z")), "post").otherwise("pre")
    return both.withColumn("cohort", cohort).withColumn("cell", F.concat(F.lit("L"), "l", F.lit("-D"), "c", F.lit("-C"), "cohort"))


def tercile_assign(spark, d):
    return _celled(spark, d).select("target_id", "repo", "l", "c", "cohort", "cell")


def _quotas(spark, d, n=60):
    labels = F.explode(F.array(*[F.lit(f"L{a}-D{b}-C{c}") for a in (1, 2, 3) for b in (1, 2, 3) for c in ("pre", "post")]))
    cells = _celled(spark, d)
    space = cells.select("repo").distinct().withColumn("cell", labels)
    pop = space.join(cells.groupBy("repo", "cell").agg(F.count(F.lit(1)).alias("population")), ["repo", "cell"], "left").withColumn("population", F.coalesce("population", F.lit(0).cast("bigint")))
    return S.hamilton(pop.withColumn("seats", F.lit(n)), ["repo"], "cell", "population", "seats")


def hamilton_quotas(spark, d):
    return _quotas(spark, d).select("repo", "cell", "population", "quota")


def stratified_sample_plan(spark, d):
    return S.top_by_quota(_celled(spark, d), _quotas(spark, d), ["repo", "cell"], ["prio", "target_id"], 60).select("repo", "cell", "target_id", "prio")


def sample_shortfalls(spark, d):
    got = stratified_sample_plan(spark, d).groupBy("repo", "cell").agg(F.count(F.lit(1)).alias("filled"))
    q = _quotas(spark, d).join(got, ["repo", "cell"], "left").withColumn("filled", F.coalesce("filled", F.lit(0).cast("bigint")))
    return q.select("repo", "cell", "quota", "filled", (F.col("quota") - F.col("filled")).alias("shortfall"), (F.col("population") - F.col("filled")).alias("unsampled"))


def first_add_record(spark, d):
    """Earliest stamp per commit over author and committer; which of the two it is."""
    c = table(spark, d, "commits").where("commit_sha is not null")
    stamps = F.explode(F.array(F.struct(F.col("author_stamp").alias("raw"), F.lit("author").alias("who")), F.struct(F.col("committer_stamp").alias("raw"), F.lit("committer").alias("who"))))
    rows = c.select("commit_sha", stamps.alias("s")).select("commit_sha", F.try_to_timestamp(F.when(F.col("s.raw").rlike(r"(Z|[+-]\d\d:\d\d)$"), F.col("s.raw"))).alias("at"), "s.who").where("at is not null")
    return rows.groupBy("commit_sha").agg(F.min(F.struct("at", "who")).alias("m")).select("commit_sha", F.unix_seconds("m.at").alias("epoch"), F.col("m.who").alias("who"))


def commit_signals(spark, d):
    c = table(spark, d, "commits").where("commit_sha is not null")
    return c.groupBy("commit_sha").agg(F.coalesce(F.max(F.col("n_files_added") >= 100), F.lit(False)).alias("bulk_import"), F.coalesce(F.max(F.col("subject").rlike(VENDOR_SUBJECT)), F.lit(False)).alias("subject_vendor"))


def candidate_clean(spark, d):
    """Files later than the earliest cutoff, by flag: what masking may use."""
    f = _files(spark, d).where(F.col("date") > "2024-11-12")
    return f.groupBy("repo", F.coalesce("flag", F.lit(False)).alias("flag")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def tree_summary(spark, d):
    """Files and bytes by top folder."""
    return _files(spark, d).groupBy("repo", F.split("rel", "/")[0].alias("top")).agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def snapshot_diff(spark, d):
    """Paths of two dated snapshots: added, removed, modified, unchanged.

    The earlier holds what was added up to the cutoff; in the later one the
    files of one ending are gone and those of another have a new content.
    """
    f = _files(spark, d).select("repo", "rel", "file_id", "bytes", "date", "ext")
    old = f.where(F.col("date") <= "2024-06-30").groupBy("repo", "rel").agg(F.min("bytes").alias("old"))
    new = f.where("ext <> 'cc'").groupBy("repo", "rel").agg(F.min(F.col("bytes") + F.when(F.col("ext") == "js", 1).otherwise(0)).alias("new"))
    both = old.join(new, ["repo", "rel"], "full_outer")
    state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return both.groupBy("repo", state.alias("state")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce("new", F.lit(0)) - F.coalesce("old", F.lit(0))).alias("byte_delta"))


def eligibility_waterfall(spark, d):
    """The first reason that excludes a target, counted."""
    t = _celled(spark, d)
    reason = F.when(F.col("added").isNull(), "no-first-add").when(F.col("body_bytes") < 60, "short-body").when(F.col("in_degree") == 0, "never-imported").otherwise("eligible")
    return t.groupBy("repo", "lang", reason.alias("reason")).agg(F.count(F.lit(1)).alias("targets"))


_NAMES = """corpus_scan stream_targets doc_priority_order greedy_budget_fill xl_nested_fill stream_manifest_offsets manifest_contiguity doc_set_hash exact_dedup_pool holdout_split
stride_thinning clean_leakage byte_match_tolerance tercile_cutpoints tercile_assign hamilton_quotas stratified_sample_plan sample_shortfalls first_add_record commit_signals candidate_clean
tree_summary snapshot_diff eligibility_waterfall""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_F = f"""f AS (SELECT file_id, repo, rel, arg_min(text, sha256(text)) AS text, min(add_date) AS date, bool_or(provenance_flag) AS flag, cast(octet_length(encode(arg_min(text, sha256(text)))) + CASE WHEN arg_min(text, sha256(text)) LIKE '%' || chr(10) THEN 0 ELSE 1 END AS BIGINT) AS bytes,
  lower(regexp_extract(rel, '\\.([A-Za-z0-9]+)$', 1)) AS ext, sha256('{SELECT_SEED}:' || rel) AS prio FROM source_files WHERE text IS NOT NULL AND rel IS NOT NULL GROUP BY file_id, repo, rel)"""


def _fold(name: str, src: str, cap: int) -> str:
    """The greedy fill as recursion over ranks."""
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY base DESC, prio, file_id) AS k FROM {src}),
  {name} AS (SELECT repo, file_id, bytes, k, (base OR bytes <= {cap}) AS taken, CASE WHEN base OR bytes <= {cap} THEN bytes ELSE 0 END AS used FROM {name}_r WHERE k = 1
  UNION ALL SELECT r.repo, r.file_id, r.bytes, r.k, (r.base OR p.used + r.bytes <= {cap}), p.used + CASE WHEN r.base OR p.used + r.bytes <= {cap} THEN r.bytes ELSE 0 END
  FROM {name} p JOIN {name}_r r ON r.repo = p.repo AND r.k = p.k + 1)"""


_FB = f"{_F}, fb AS (SELECT *, false AS base FROM f)"
_SPANS = f"{_F}, m AS (SELECT repo, file_id, cast(sum(bytes) OVER (PARTITION BY repo ORDER BY rel, file_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS e, bytes FROM f), s AS (SELECT repo, file_id, e - bytes AS start, e AS \"end\" FROM m)"
_T = "t AS (SELECT target_id, max(repo) AS repo, max(lang) AS lang, max(body_bytes) AS body_bytes, max(module_in_degree) AS in_degree, max(first_add_utc) AS added, sha256('v2a:' || max(repo) || ':' || target_id) AS prio FROM candidates GROUP BY target_id)"


def _cut(name: str, value: str) -> str:
    return f"""{name} AS (SELECT repo, max(n) AS n, min({value}) FILTER (WHERE k = (n - 1) // 3) AS q1, min({value}) FILTER (WHERE k = 2 * (n - 1) // 3) AS q2
  FROM (SELECT repo, {value}, row_number() OVER (PARTITION BY repo ORDER BY {value}) - 1 AS k, count(*) OVER (PARTITION BY repo) AS n FROM t WHERE {value} IS NOT NULL) GROUP BY repo)"""


_C = f"""{_T}, {_cut("ql", "body_bytes")}, {_cut("qc", "in_degree")}, c AS (SELECT t.*, CASE WHEN body_bytes <= ql.q1 THEN 1 WHEN body_bytes <= ql.q2 THEN 2 ELSE 3 END AS l,
  CASE WHEN in_degree <= qc.q1 THEN 1 WHEN in_degree <= qc.q2 THEN 2 ELSE 3 END AS c, CASE WHEN cast(added AS TIMESTAMPTZ) > TIMESTAMPTZ '2024-11-12 23:59:59+00' THEN 'post' ELSE 'pre' END AS cohort
  FROM t JOIN ql ON t.repo = ql.repo JOIN qc ON t.repo = qc.repo), cells AS (SELECT *, 'L' || l || '-D' || c || '-C' || cohort AS cell FROM c)"""
_LABELS = ", ".join(f"('L{a}-D{b}-C{c}')" for a in (1, 2, 3) for b in (1, 2, 3) for c in ("pre", "post"))
_Q = f"""{_C}, lab(cell) AS (VALUES {_LABELS}), pop AS (SELECT r.repo, lab.cell, (SELECT count(*) FROM cells x WHERE x.repo = r.repo AND x.cell = lab.cell) AS population FROM (SELECT DISTINCT repo FROM cells) r, lab),
  tot AS (SELECT *, sum(population) OVER (PARTITION BY repo) AS total FROM pop), fl AS (SELECT *, 60 * population // total AS fl, (60 * population) % total AS rem FROM tot),
  q AS (SELECT repo, cell, population, cast(fl + CASE WHEN row_number() OVER (PARTITION BY repo ORDER BY rem DESC, cell) <= 60 - sum(fl) OVER (PARTITION BY repo) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM fl),
  sp AS (SELECT * FROM (SELECT cells.repo, cells.cell, target_id, prio, quota, row_number() OVER (PARTITION BY cells.repo, cells.cell ORDER BY prio, target_id) AS k FROM cells JOIN q ON cells.repo = q.repo AND cells.cell = q.cell) WHERE k <= quota)"""

ORACLE = {
    "corpus_scan": f"WITH {_F} SELECT repo, ext, count(*) AS files, cast(sum(bytes) AS BIGINT) AS bytes FROM f WHERE bytes >= 64 GROUP BY repo, ext",
    "stream_targets": f"""WITH {_F}, p AS (SELECT repo, cast(sum(bytes) AS BIGINT) AS fu, cast(coalesce(sum(bytes) FILTER (WHERE date > '2024-11-12'), 0) AS BIGINT) AS cl FROM f GROUP BY repo)
      SELECT least({CAP}, min(fu)) AS full_target, coalesce(min(cl) FILTER (WHERE cl >= {CLEAN_FLOOR}), 0) AS clean_target FROM p""",
    "doc_priority_order": f"WITH {_F} SELECT file_id, repo, prio FROM f",
    "greedy_budget_fill": f"WITH RECURSIVE {_FB}, {_fold('g', 'fb', CAP)} SELECT repo, file_id, bytes, cast(used AS BIGINT) AS used FROM g WHERE taken",
    "xl_nested_fill": f"WITH RECURSIVE {_FB}, {_fold('a', 'fb', BASE_CAP)}, fx AS (SELECT f.*, coalesce(a.taken, false) AS base FROM f LEFT JOIN a ON a.file_id = f.file_id), {_fold('x', 'fx', CAP)} SELECT repo, file_id, bytes, cast(used AS BIGINT) AS used FROM x WHERE taken",
    "stream_manifest_offsets": f'WITH {_SPANS} SELECT repo, file_id, start, "end" FROM s',
    "manifest_contiguity": f'WITH {_SPANS}, g AS (SELECT *, start - coalesce(lag("end") OVER (PARTITION BY repo ORDER BY start, file_id), 0) AS gap FROM s) SELECT repo, count(*) AS docs, count(*) FILTER (WHERE gap <> 0) AS gaps, max("end") AS stream_bytes, count(*) - count(DISTINCT file_id) AS repeated_ids FROM g GROUP BY repo',
    "doc_set_hash": f"WITH {_F}, h0 AS (SELECT repo, sha256(file_id || ':' || prio) AS h, sha256(file_id || ':' || prio) AS p FROM f), "
    + ", ".join(f"h{i + 1} AS (SELECT repo, substr(p, 1, {n}) AS p, sha256(string_agg(h, '' ORDER BY p, h)) AS h FROM h{i} GROUP BY repo, substr(p, 1, {n}))" for i, n in enumerate(S.DIGEST_LEVELS))
    + f" SELECT repo, h AS set_sha256 FROM h{len(S.DIGEST_LEVELS)}",
    "exact_dedup_pool": f"WITH {_F} SELECT sha1(text) AS sha1, count(*) AS copies, arg_min(file_id, {{'a': repo, 'b': rel, 'c': file_id}}) AS file_id FROM f GROUP BY sha1(text)",
    "holdout_split": f"WITH {_F}, n AS (SELECT ext, file_id, row_number() OVER (PARTITION BY ext ORDER BY prio, file_id) - 1 AS position FROM f) SELECT *, position % 10 = 7 AS held_out FROM n",
    "stride_thinning": f"""WITH {_F}, n AS (SELECT ext, file_id, bytes, prio, row_number() OVER (PARTITION BY ext ORDER BY prio, file_id) - 1 AS position, sum(bytes) OVER (PARTITION BY ext) AS total FROM f),
      s AS (SELECT *, CASE WHEN total > 20000 THEN greatest(1, cast(round_even(total / 20000, 0) AS BIGINT)) ELSE 1 END AS step FROM n),
      k AS (SELECT *, coalesce(sum(CASE WHEN position % step = 0 THEN bytes END) OVER (PARTITION BY ext ORDER BY prio, file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
      SELECT ext, file_id, position, step FROM k WHERE position % step = 0 AND (total <= 20000 OR before < 20000)""",
    "clean_leakage": f"WITH {_F} SELECT repo, count(*) FILTER (WHERE coalesce(date <= '2024-11-12', true)) AS leaks, count(*) AS files FROM f GROUP BY repo",
    "byte_match_tolerance": f"""WITH RECURSIVE {_FB}, {_fold('g', 'fb', CAP)}, r AS (SELECT repo, max(used) AS got FROM g WHERE taken GROUP BY repo), a AS (SELECT count(*) AS cells, round(max(abs(got - {CAP})) / {CAP}, 6) AS worst,
      round((max(got) - min(got)) / {CAP}, 6) AS spread FROM r) SELECT *, cells >= 2 AND worst <= 0.1 AND spread <= 0.1 AS passed FROM a""",
    "tercile_cutpoints": f"WITH {_T}, {_cut('ql', 'body_bytes')} SELECT repo, n, q1, q2 FROM ql",
    "tercile_assign": f"WITH {_C} SELECT target_id, repo, l, c, cohort, cell FROM cells",
    "hamilton_quotas": f"WITH {_Q} SELECT repo, cell, population, quota FROM q",
    "stratified_sample_plan": f"WITH {_Q} SELECT repo, cell, target_id, prio FROM sp",
    "sample_shortfalls": f"""WITH {_Q} SELECT q.repo, q.cell, quota, (SELECT count(*) FROM sp WHERE sp.repo = q.repo AND sp.cell = q.cell) AS filled,
      quota - (SELECT count(*) FROM sp WHERE sp.repo = q.repo AND sp.cell = q.cell) AS shortfall, population - (SELECT count(*) FROM sp WHERE sp.repo = q.repo AND sp.cell = q.cell) AS unsampled FROM q""",
    "first_add_record": """WITH s AS (SELECT commit_sha, cast(author_stamp AS TIMESTAMPTZ) AS ts, 'author' AS who FROM commits UNION ALL SELECT commit_sha, cast(committer_stamp AS TIMESTAMPTZ), 'committer' FROM commits),
      m AS (SELECT commit_sha, min({'a': ts, 'w': who}) AS m FROM s WHERE ts IS NOT NULL GROUP BY commit_sha) SELECT commit_sha, cast(floor(epoch(m.a)) AS BIGINT) AS epoch, m.w AS who FROM m""",
    "commit_signals": r"""SELECT commit_sha, coalesce(bool_or(n_files_added >= 100), false) AS bulk_import,
      coalesce(bool_or(regexp_matches(subject, '(?i)\b(vendor|port(ed|ing)?\b|import(ed)? from|copied|migrat(e|ed|ion)|upstream)\b')), false) AS subject_vendor FROM commits GROUP BY commit_sha""",
    "candidate_clean": f"WITH {_F} SELECT repo, coalesce(flag, false) AS flag, count(*) AS files, cast(sum(bytes) AS BIGINT) AS bytes FROM f WHERE date > '2024-11-12' GROUP BY repo, coalesce(flag, false)",
    "tree_summary": f"WITH {_F} SELECT repo, split_part(rel, '/', 1) AS top, count(*) AS files, cast(sum(bytes) AS BIGINT) AS bytes FROM f GROUP BY repo, split_part(rel, '/', 1)",
    "snapshot_diff": f"""WITH {_F}, o AS (SELECT repo, rel, min(bytes) AS old FROM f WHERE date <= '2024-06-30' GROUP BY repo, rel), n AS (SELECT repo, rel, min(bytes + CASE WHEN ext = 'js' THEN 1 ELSE 0 END) AS new FROM f WHERE ext <> 'cc' GROUP BY repo, rel),
      b AS (SELECT coalesce(o.repo, n.repo) AS repo, old, new FROM o FULL JOIN n ON o.repo = n.repo AND o.rel = n.rel)
      SELECT repo, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old <> new THEN 'modified' ELSE 'unchanged' END AS state, count(*) AS files, cast(sum(coalesce(new, 0) - coalesce(old, 0)) AS BIGINT) AS byte_delta FROM b GROUP BY 1, 2""",
    "eligibility_waterfall": f"""WITH {_C} SELECT repo, lang, CASE WHEN added IS NULL THEN 'no-first-add' WHEN body_bytes < 60 THEN 'short-body' WHEN in_degree = 0 THEN 'never-imported' ELSE 'eligible' END AS reason, count(*) AS targets FROM cells GROUP BY 1, 2, 3""",
}
