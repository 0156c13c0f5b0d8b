"""Queries of records, near duplicates, packs and ranking over units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import lexers
from tessella.operators import blocks, selection
from tessella.operators import similarity as S
from tessella.scratch import Scratch
from tessella.sources.tables import table


def _units(spark: SparkSession, d: str) -> DataFrame:
    """One row per unit with its records."""
    u = table(spark, d, "units").where("unit_id is not null and payload is not null")
    one = u.groupBy("unit_id").agg(F.min(F.struct("payload", "repo", "lang")).alias("r")).select("unit_id", "r.payload", F.coalesce("r.repo", F.lit("")).alias("repo"), F.coalesce("r.lang", F.lit("")).alias("lang"))
    return one.withColumn("tokens", S.records("payload")).withColumn("n_records", F.size("tokens"))


def lexical_records(spark, d):
    """Records by kind per unit."""
    t = _units(spark, d).select("unit_id", F.explode("tokens").alias("t"))
    return t.groupBy("unit_id", S.kind_of(F.col("t")).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("t").alias("n_distinct"))


def verbatim_hash(spark, d):
    return _units(spark, d).select("unit_id", S.verbatim_hash("tokens").alias("verbatim"))


def normalized_hash(spark, d):
    return _units(spark, d).select("unit_id", S.verbatim_hash(S.normalized("tokens")).alias("normalized"))


def five_grams(spark, d):
    g = _units(spark, d).select("unit_id", "n_records", S.grams("tokens").alias("g"))
    return g.select("unit_id", F.size("g").alias("n_grams"), F.array_min(F.transform("g", lambda x: F.sha2(x, 256))).alias("least"))


def _sets(spark, d):
    return _units(spark, d).where(F.col("n_records") >= S.LEAST_RECORDS).select("unit_id", S.grams("tokens").alias("g"))


def jaccard_pairs(spark, d):
    return S.jaccard_pairs(_sets(spark, d), "unit_id", "g")


def gram_classes(spark, d):
    return S.classes(_sets(spark, d), "unit_id", "g")


def jaccard_bins(spark, d):
    p = jaccard_pairs(spark, d)
    return p.groupBy(S.ratio_bin(F.col("n_inter"), F.col("n_union")).alias("bin")).agg(F.count(F.lit(1)).alias("pairs"))


def _hashed(spark, d):
    u = _units(spark, d)
    return u.select("unit_id", "repo", "n_records", S.verbatim_hash("tokens").alias("verb"), S.verbatim_hash(S.normalized("tokens")).alias("norm"))


def collision_groups(spark, d):
    return S.collisions(_hashed(spark, d), [], "norm", "verb")


def seeded_member_pair(spark, d):
    u = Scratch(spark).cut(_hashed(spark, d), "units")
    return S.member_pair(u, S.collisions(u, [], "norm", "verb"), [], "norm", "verb", "unit_id", selection.priority("member:v1", "norm", "unit_id"))


def near_dup_adjacency(spark, d):
    """Pairs of units that are verbatim twins, normalised twins or alike in grams; both directions.

    Twins are linked to the first of their kind, which keeps a group of copies linear.
    """
    u = Scratch(spark).cut(_hashed(spark, d), "units")
    return S.adjacency(u, jaccard_pairs(spark, d), "unit_id", "verb", "norm")


def _typed(spark, d):
    """Fingerprints of the units from the lexer of their language; those without a language are read as Lean."""
    u = table(spark, d, "units").where("unit_id is not null and payload is not null").groupBy("unit_id").agg(F.min(F.struct("payload", "lang")).alias("r"))
    return Scratch(spark).cut(lexers.fingerprint_table(u.select("unit_id", "r.payload", "r.lang"), "unit_id", "payload", "lang"), "typed")


def typed_fingerprints(spark, d):
    """Records, lexical records, verbatim and normalised hash of each unit, or why it doesn't lex."""
    return _typed(spark, d).select("unit_id", "n_records", "n_lexical", "verbatim", "normalized", F.size(F.coalesce("grams", F.array().cast("array<bigint>"))).alias("n_grams"), "error")


def _typed_pairs(typed):
    return S.jaccard_pairs(typed.where(F.col("n_lexical") >= S.LEAST_RECORDS), "unit_id", "grams")


def typed_jaccard_pairs(spark, d):
    """Pairs of representatives of equal gram sets of typed records that are alike."""
    return _typed_pairs(_typed(spark, d))


def typed_collision_groups(spark, d):
    """Normalised hashes of typed records shared by units with different verbatim hashes."""
    return S.collisions(_typed(spark, d).where("error is null"), [], "normalized", "verbatim")


def typed_adjacency(spark, d):
    """Units that are verbatim twins, normalised twins or alike, by typed records."""
    t = _typed(spark, d)
    return S.adjacency(t, _typed_pairs(t), "unit_id", "verbatim", "normalized")


def audit_pack_round_robin(spark, d):
    """Up to 8 pairs per bin, one repo after the other, shown in another seeded order."""
    p = jaccard_pairs(spark, d).withColumn("bin", S.ratio_bin(F.col("n_inter"), F.col("n_union")))
    r = _units(spark, d).select(F.col("unit_id").alias("a"), "repo")
    rows = p.join(r, "a").withColumn("h", selection.priority("pack:v1", "a", "b"))
    return selection.round_robin(rows, ["bin"], "repo", ["h"], 8).select("bin", "slot", "a", "b", selection.priority("show:v1", "a", "b").alias("shown"))


def _labels(spark, d):
    """A stand-in for human labels: a pair counts as duplicate if its hash is not divisible by 5."""
    pack = Scratch(spark).cut(audit_pack_round_robin(spark, d), "pack")
    return pack.withColumn("dup", F.pmod(F.conv(F.substring("shown", 1, 8), 16, 10).cast("bigint"), F.lit(5)) != 0)


def jaccard_outcome(spark, d):
    """Label precision at and above each bin, and whether nine in ten hold."""
    lab = _labels(spark, d).withColumn("level", F.explode(F.array(*[F.lit(int(x)) for x, _ in S.BINS])))
    least = F.create_map(*[F.lit(v) for x, n in S.BINS for v in (n, int(x))])
    rows = lab.where(least[F.col("bin")] >= F.col("level"))
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("labelled"), F.count_if("dup").alias("dups")).withColumn("holds", (F.col("dups") * 10 >= F.col("labelled") * 9) & (F.col("labelled") >= 8))


def collision_activation(spark, d):
    """A band is active if exactly 8 of its groups were labelled and all are clones (here: of an even number of members)."""
    g = collision_groups(spark, d).withColumn("h", selection.priority("band:v1", "norm"))
    pick = selection.round_robin(g.withColumn("turn", F.lit("")), ["band"], "turn", ["h"], 8)
    out = pick.groupBy("band").agg(F.count(F.lit(1)).alias("labelled"), F.count_if(F.col("members") % 2 == 0).alias("clones"))
    return out.withColumn("active", (F.col("labelled") == 8) & (F.col("clones") == 8))


def contamination_screen(spark, d):
    """Units of python against those of lean or none: the first way in which one meets an outside unit."""
    u = Scratch(spark).cut(_units(spark, d).select("unit_id", "lang", S.verbatim_hash("tokens").alias("verb"), S.verbatim_hash(S.normalized("tokens")).alias("norm")), "units")
    targets, outside = u.where("lang = 'python'"), u.where("lang <> 'python'")
    seen = lambda c: outside.select(c).distinct().withColumn(f"m_{c}", F.lit(True))
    p = jaccard_pairs(spark, d)
    cls = Scratch(spark).cut(gram_classes(spark, d), "classes")
    far = cls.join(outside.select(F.col("unit_id").alias("id")), "id").select("class_id").distinct()
    both = p.select("a", "b").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(cls.select(F.col("class_id").alias("a"), F.col("class_id").alias("b")).distinct())
    near = cls.join(both.join(far.withColumnRenamed("class_id", "b"), "b").select(F.col("a").alias("class_id")).distinct(), "class_id").select(F.col("id").alias("unit_id"), F.lit(True).alias("m_near"))
    rows = targets.join(seen("verb"), "verb", "left").join(seen("norm"), "norm", "left").join(near, "unit_id", "left")
    return rows.select("unit_id", F.when(F.col("m_verb"), "verbatim").when(F.col("m_norm"), "normalized").when(F.col("m_near"), "jaccard").otherwise("clean").alias("reason"))


def bm25_topk(spark, d):
    """The ten best units for each unit whose id is divisible by 50, by the words of its text."""
    t = _units(spark, d).select(F.lit(0).alias("scope"), F.col("unit_id").alias("id"), F.transform("tokens", lambda x: F.xxhash64(x)).alias("items"))
    best = blocks.bm25(Scratch(spark).cut(t, "tokens"), "id % 50 = 0", top=10)
    return S.top_k(best, 10).select("query", "id", "place", F.round("score", 5).alias("score"))


_NAMES = """lexical_records verbatim_hash normalized_hash five_grams jaccard_pairs gram_classes jaccard_bins collision_groups seeded_member_pair near_dup_adjacency audit_pack_round_robin
jaccard_outcome collision_activation contamination_screen bm25_topk typed_fingerprints typed_jaccard_pairs typed_collision_groups typed_adjacency""".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_U = f"""p AS (SELECT unit_id, min({{'p': payload, 'r': repo, 'l': lang}}) AS r FROM units WHERE payload IS NOT NULL GROUP BY unit_id),
  u AS (SELECT unit_id, coalesce(r.r, '') AS repo, coalesce(r.l, '') AS lang, regexp_extract_all(r.p, '{S.TOKEN}') AS tokens FROM p),
  h AS (SELECT unit_id, repo, lang, len(tokens) AS n_records, sha256(array_to_string(tokens, ' ')) AS verb,
    sha256(array_to_string(list_transform(tokens, lambda t: CASE WHEN regexp_matches(t, '^[A-Za-z_]') THEN '#' || list_position(ws, t) ELSE t END), ' ')) AS norm
    FROM (SELECT *, list_transform(list_sort(list_distinct(list_transform(list_filter(list_zip(range(len(tokens)), tokens), lambda z: regexp_matches(z[2], '^[A-Za-z_]')), lambda z: {{'k': list_position(tokens, z[2]), 't': z[2]}}))), lambda s: s.t) AS ws FROM u))"""
_SETS = f"""{_U}, s AS (SELECT unit_id, list_sort(list_distinct(list_transform(range(1, len(tokens) - 3), lambda k: array_to_string(list_slice(tokens, k, k + 4), ' ')))) AS g FROM u WHERE len(tokens) >= 20),
  cl AS (SELECT unit_id, min(unit_id) OVER (PARTITION BY g) AS class_id, g FROM s), rp AS (SELECT unit_id, g, len(g) AS n FROM cl WHERE unit_id = class_id), fl AS (SELECT unit_id, n, unnest(g) AS h FROM rp),
  jp AS (SELECT a.unit_id AS a, b.unit_id AS b, count(*) AS i, any_value(a.n + b.n) AS t FROM fl a JOIN fl b ON a.h = b.h AND a.unit_id < b.unit_id GROUP BY a.unit_id, b.unit_id HAVING 10 * count(*) >= 7 * (any_value(a.n + b.n) - count(*))),
  j AS (SELECT a, b, cast(i AS INT) AS n_inter, cast(t - i AS INT) AS n_union, CASE WHEN 100 * i >= 90 * (t - i) THEN 'B5' WHEN 100 * i >= 85 * (t - i) THEN 'B4' WHEN 100 * i >= 80 * (t - i) THEN 'B3' WHEN 100 * i >= 75 * (t - i) THEN 'B2' ELSE 'B1' END AS bin FROM jp)"""
_COL = "co AS (SELECT norm, count(*) AS members, count(DISTINCT verb) AS verbatims, max(n_records) AS n_records FROM h GROUP BY norm HAVING count(DISTINCT verb) >= 2)"
_PACK = f"""{_SETS}, pr AS (SELECT j.*, u.repo, sha256('pack:v1:' || a || ':' || b) AS hh FROM j JOIN u ON u.unit_id = j.a), n1 AS (SELECT *, row_number() OVER (PARTITION BY bin, repo ORDER BY hh) AS nth FROM pr),
  n2 AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY nth, repo) AS slot FROM n1), pk AS (SELECT bin, cast(slot AS INT) AS slot, a, b, sha256('show:v1:' || a || ':' || b) AS shown FROM n2 WHERE slot <= 8)"""

ORACLE = {
    "lexical_records": f"""WITH {_U}, t AS (SELECT unit_id, unnest(tokens) AS t FROM u) SELECT unit_id, CASE WHEN regexp_matches(t, '^[A-Za-z_]') THEN 'WORD' WHEN regexp_matches(t, '^[0-9]') THEN 'NUM' ELSE 'OP' END AS kind,
      count(*) AS n, count(DISTINCT t) AS n_distinct FROM t GROUP BY 1, 2""",
    "verbatim_hash": f"WITH {_U} SELECT unit_id, verb AS verbatim FROM h",
    "normalized_hash": f"WITH {_U} SELECT unit_id, norm AS normalized FROM h",
    "five_grams": f"""WITH {_U}, g AS (SELECT unit_id, list_distinct(list_transform(range(1, len(tokens) - 3), lambda k: array_to_string(list_slice(tokens, k, k + 4), ' '))) AS g FROM u)
      SELECT unit_id, cast(len(g) AS INT) AS n_grams, list_min(list_transform(g, lambda x: sha256(x))) AS least FROM g""",
    "jaccard_pairs": f"WITH {_SETS} SELECT a, b, n_inter, n_union FROM j",
    "gram_classes": f"WITH {_SETS} SELECT unit_id AS id, class_id FROM cl",
    "jaccard_bins": f"WITH {_SETS} SELECT bin, count(*) AS pairs FROM j GROUP BY bin",
    "collision_groups": f"WITH {_U}, {_COL} SELECT norm, members, verbatims, cast(n_records AS INT) AS n_records, CASE WHEN n_records < 20 THEN 'under20' ELSE 'geq20' END AS band FROM co",
    "seeded_member_pair": f"""WITH {_U}, {_COL}, r AS (SELECT h.*, sha256('member:v1:' || h.norm || ':' || unit_id) AS hh FROM h JOIN co ON h.norm = co.norm), f AS (SELECT norm, min({{'h': hh, 'k': unit_id, 'v': verb}}) AS f FROM r GROUP BY norm)
      SELECT r.norm, f.f.k AS left_id, min({{'h': hh, 'k': unit_id}}).k AS right_id FROM r JOIN f ON r.norm = f.norm WHERE r.verb <> f.f.v GROUP BY r.norm, f.f.k""",
    "near_dup_adjacency": f"""WITH {_SETS}, l AS (SELECT a, b FROM j UNION ALL SELECT hub, unit_id FROM (SELECT min(unit_id) OVER (PARTITION BY verb) AS hub, unit_id FROM h) WHERE hub <> unit_id
      UNION ALL SELECT hub, unit_id FROM (SELECT min(unit_id) OVER (PARTITION BY norm) AS hub, unit_id FROM h) WHERE hub <> unit_id), o AS (SELECT a, b, count(*) AS reasons FROM l GROUP BY a, b) SELECT * FROM o UNION ALL SELECT b, a, reasons FROM o""",
    "audit_pack_round_robin": f"WITH {_PACK} SELECT * FROM pk",
    "jaccard_outcome": f"""WITH {_PACK}, lv(level) AS (VALUES (70), (75), (80), (85), (90)), m(bin, least) AS (VALUES ('B1', 70), ('B2', 75), ('B3', 80), ('B4', 85), ('B5', 90)),
      o AS (SELECT level, count(*) AS labelled, count(*) FILTER (WHERE cast('0x' || substr(shown, 1, 8) AS BIGINT) % 5 <> 0) AS dups FROM pk JOIN m ON pk.bin = m.bin JOIN lv ON m.least >= lv.level GROUP BY level)
      SELECT *, dups * 10 >= labelled * 9 AND labelled >= 8 AS holds FROM o""",
    "collision_activation": f"""WITH {_U}, {_COL}, k AS (SELECT CASE WHEN n_records < 20 THEN 'under20' ELSE 'geq20' END AS band, members, row_number() OVER (PARTITION BY CASE WHEN n_records < 20 THEN 'under20' ELSE 'geq20' END ORDER BY sha256('band:v1:' || norm)) AS k FROM co),
      o AS (SELECT band, count(*) AS labelled, count(*) FILTER (WHERE members % 2 = 0) AS clones FROM k WHERE k <= 8 GROUP BY band) SELECT *, labelled = 8 AND clones = 8 AS active FROM o""",
    "contamination_screen": f"""WITH {_SETS}, bo AS (SELECT a, b FROM j UNION ALL SELECT b, a FROM j UNION ALL SELECT DISTINCT class_id, class_id FROM cl), o AS (SELECT * FROM h WHERE lang <> 'python'),
      nr AS (SELECT DISTINCT t.unit_id FROM cl t JOIN bo ON bo.a = t.class_id JOIN cl x ON x.class_id = bo.b JOIN o ON o.unit_id = x.unit_id)
      SELECT unit_id, CASE WHEN verb IN (SELECT verb FROM o) THEN 'verbatim' WHEN norm IN (SELECT norm FROM o) THEN 'normalized' WHEN unit_id IN (SELECT unit_id FROM nr) THEN 'jaccard' ELSE 'clean' END AS reason FROM h WHERE lang = 'python'""",
    "bm25_topk": f"""WITH {_U}, t AS (SELECT unit_id, unnest(tokens) AS term FROM u), ps AS (SELECT unit_id AS id, term, count(*) AS tf FROM t GROUP BY 1, 2), sz AS (SELECT id, sum(tf) AS size FROM ps GROUP BY id), st AS (SELECT count(*) AS n, avg(size) AS av FROM sz),
      q AS (SELECT id AS query, term, tf AS qtf FROM ps WHERE id % 50 = 0), df AS (SELECT term, count(*) AS df FROM ps GROUP BY term),
      sc AS (SELECT query, ps.id, cast(sum(cast(round(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * size / av)), 9) AS DECIMAL(28,9))) AS DOUBLE) AS score
      FROM q JOIN df ON q.term = df.term JOIN ps ON ps.term = q.term JOIN sz ON sz.id = ps.id, st WHERE ps.id <> query GROUP BY query, ps.id),
      r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM sc) SELECT query, id, cast(place AS INT) AS place, round(score, 5) AS score FROM r WHERE place <= 10""",
}
