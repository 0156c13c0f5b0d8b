"""Arms of contexts over units: closures of references, the universe left by what must not be shown, random and ranked orders, budgets.

Targets are the units whose id is divisible by 50, against all units of their
repo. A unit refers to another of its repo if it names it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import scalars
from tessella.joins import BROADCAST_ROWS, split_join
from tessella.operators import assembly as A
from tessella.operators import blocks, contexts, graph
from tessella.operators import similarity as S
from tessella.operators.selection import priority
from tessella.plans import similarity as texts
from tessella.plans.similarity import _SETS
from tessella.scratch import Scratch
from tessella.sources.tables import table

SEEDS = (0, 1, 2)


def _units(spark: SparkSession, d: str) -> DataFrame:
    """Unit, repo, path, declared name, bytes with one line feed at the end, words."""
    name = F.get(F.from_json("identity", "array<string>"), F.lit(1))
    u = table(spark, d, "units").where("unit_id is not null and payload is not null and repo is not null")
    words = F.array_sort(F.array_distinct(F.regexp_extract_all("payload", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))))
    size = F.octet_length(scalars.one_line_feed("payload")).cast("bigint")
    one = u.groupBy(F.col("unit_id").alias("unit")).agg(F.min("repo").alias("repo"), F.min("relpath").alias("path"), F.min(name).alias("name"), F.min(size).alias("size"), F.min(words).alias("words"))
    return Scratch(spark).cut(one, "units")


def _edges(units: DataFrame) -> DataFrame:
    named = units.where("name is not null").select("repo", F.col("name").alias("word"), F.col("unit").alias("dst"))
    return units.select("repo", F.col("unit").alias("src"), F.explode("words").alias("word")).join(named, ["repo", "word"]).where("src <> dst").select("src", "dst").distinct()


def unit_references(spark, d):
    """Units of a repo that name one another."""
    return _edges(_units(spark, d))


def _near(spark: SparkSession, d: str, units: DataFrame) -> DataFrame:
    """``near_dup_adjacency`` of the targets with units of their repo: as other pairs are no pairs of an arm, none is looked for."""
    t = texts._units(spark, d)
    g = F.when(F.col("n_records") >= S.LEAST_RECORDS, F.array_sort(F.transform(S.grams("tokens"), lambda x: F.xxhash64(x))))
    u = Scratch(spark).cut(t.select("unit_id", S.verbatim_hash("tokens").alias("verb"), S.verbatim_hash(S.normalized("tokens")).alias("norm"), g.alias("g")), "near")
    reps = u.where("g is not null").groupBy("g").agg(F.min("unit_id").alias("id"))
    sets = Scratch(spark).cut(reps.join(units.select(F.col("unit").alias("id"), F.col("repo").alias("scope")), "id").select("scope", "id", F.col("g").alias("items")), "sets")
    alike = blocks.overlaps(sets.where("id % 50 = 0").withColumnRenamed("id", "query"), sets, S.NUM, S.DEN)
    pairs = alike.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).distinct()
    return S.adjacency(u, pairs, "unit_id", "verb", "norm").where("a % 50 = 0").select(F.col("a").alias("target"), F.col("b").alias("unit"), F.lit(True).alias("near"))


def _marked(spark: SparkSession, d: str, scored: bool = False) -> DataFrame:
    """Each target with every other unit of its repo, why that must not be shown or is needed, and its score."""
    scratch = Scratch(spark)
    u = _units(spark, d)
    e = scratch.cut(_edges(u), "edges")
    t = u.where("unit % 50 = 0").select(F.col("unit").alias("target"), "repo", F.col("path").alias("t_path"))
    roots = t.select(F.col("target").alias("src"))
    closure = graph.reachable(e, roots).select(F.col("src").alias("target"), F.col("dst").alias("unit"), F.col("dist").alias("hops"))
    back = graph.reachable(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots).select(F.col("src").alias("target"), F.col("dst").alias("unit"), F.lit(True).alias("dependent"))
    near = scratch.cut(_near(spark, d, u), "near")
    pairs = t.join(u.select("unit", "repo", "path", "size"), "repo").where("unit <> target").withColumn("same_file", F.col("path") == F.col("t_path"))
    for flags in (closure, back, near):
        pairs = pairs.join(flags, ["target", "unit"], "left")
    if scored:
        pairs = pairs.join(_scores(u), ["target", "unit"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return scratch.cut(pairs.select("target", "unit", "size", "hops", no("same_file"), no("dependent"), no("near"), *["score"] * scored), "pairs")


_SHOWN = "not (same_file or dependent or near)"


def arm_universe(spark, d):
    """Per target: units of the repo, those of the same file, near duplicates, dependents, the universe left, the closure and the pool beyond it."""
    m = _marked(spark, d)
    n = lambda rule, name: F.count_if(F.expr(rule)).alias(name)
    return m.groupBy("target").agg(
        F.count(F.lit(1)).alias("all_units"), n("same_file", "same_file"), n("near", "near"), n("dependent", "dependents"), n(_SHOWN, "universe"), n("hops is not null", "closure"), n(f"{_SHOWN} and hops is null", "pool")
    )


def _scores(units: DataFrame) -> DataFrame:
    """BM25 of each target's words against every unit of its repo that shares one, statistics over all units."""
    docs = Scratch(units.sparkSession).cut(units.select(F.col("repo").alias("scope"), F.col("unit").alias("id"), F.transform("words", lambda x: F.xxhash64(x)).alias("items")), "words")
    return blocks.bm25(docs, "id % 50 = 0").select(F.col("query").alias("target"), F.col("id").alias("unit"), "score")


def _rows(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    """What ``contexts.coded`` reads of each unit, or of those in ``only``; a text is shuffled only where its unit has several rows."""
    t = table(spark, d, "units").where("unit_id is not null")
    again = Scratch(spark).cut(t.groupBy(F.col("unit_id").alias("unit")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("unit"), "again")
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    name = F.get(F.from_json("identity", "array<string>"), F.lit(1))
    in_repo = lambda c: F.when(F.col("repo").isNotNull(), c)
    rows = t.where("payload is not null").select(F.col("unit_id").alias("unit"), "repo", in_repo(F.col("relpath")).alias("path"), in_repo(name).alias("name"), "payload")
    if only is not None:
        rows = rows.join(only, "unit", "left_semi")
    words = F.array_sort(F.array_distinct(F.regexp_extract_all("payload", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))))
    several = rows.join(again, "unit", "left_semi").groupBy("unit").agg(F.min("repo").alias("repo"), F.min("path").alias("path"), F.min("name").alias("name"), F.min("payload").alias("payload"), F.min_by("payload", in_repo(words)).alias("other"))
    one = rows.join(again, "unit", "left_anti").withColumn("other", F.lit(None).cast("string")).unionByName(several)
    return one.withColumn("file", F.when(F.col("path").isNotNull(), F.xxhash64("path"))).withColumn("other", F.nullif("other", F.col("payload")))


def _alike(spark: SparkSession, d: str, coded: DataFrame) -> DataFrame:
    """Pairs of targets and units as in ``_near``, and those of units of other repos with the same records."""
    scratch = Scratch(spark)
    classes = scratch.cut(coded.where("gset is not null").groupBy("gset").agg(F.min("unit").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m"), "classes")
    copies = scratch.cut(coded.select("unit", "gset").join(classes, "gset").where("unit <> first").select("unit"), "copies")
    sets = coded.where("gset is not null and repo is not null").select(F.col("repo").alias("scope"), F.col("unit").alias("id"), "n", F.col("grams").alias("items"))
    copies = copies.withColumnRenamed("unit", "id")
    sets = sets.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "id", "left_anti")
    maybe = scratch.cut(contexts.likely(sets.where("id % 50 = 0").withColumnRenamed("id", "query"), sets, S.NUM, S.DEN), "likely")
    ids = scratch.cut(maybe.select(F.col("query").alias("unit")).union(maybe.select("id")).distinct(), "ids")
    whole = scratch.cut(contexts.coded(_rows(spark, d, ids), whole=True).select("unit", "grams"), "grams")
    both = maybe.join(whole.select(F.col("unit").alias("query"), F.col("grams").alias("x")), "query").join(whole.select(F.col("unit").alias("id"), F.col("grams").alias("y")), "id")
    inter = F.size(F.array_intersect("x", "y"))
    found = both.where(S.meets(inter, F.size("x") + F.size("y") - inter)).select(F.col("query").alias("target"), F.col("id").alias("unit"))
    for c in ("verb", "norm"):
        first = coded.groupBy(c).agg(F.min("unit").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
        star = split_join(coded.select("unit", c), first, [c]).where("hub <> unit")
        found = found.unionByName(star.where("hub % 50 = 0").select(F.col("hub").alias("target"), "unit")).unionByName(star.where("unit % 50 = 0").select(F.col("unit").alias("target"), F.col("hub").alias("unit")))
    return found.distinct()


def _contexts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, float, DataFrame]:
    """Targets with what isn't shown to them and what they need, documents, the mean number of words, closures of the targets."""
    scratch = Scratch(spark)
    coded = scratch.cut(contexts.coded(_rows(spark, d)), "coded")
    docs = coded.where("repo is not null").select(F.col("repo").alias("scope"), F.col("unit").alias("id"), F.col("words").alias("items"), "file")
    targets = coded.where("repo is not null and unit % 50 = 0").select(F.col("repo").alias("scope"), F.col("unit").alias("query"), F.col("words").alias("items"), "file")
    e = scratch.cut(contexts.named(coded.where("repo is not null and name is not null").select(F.col("repo").alias("scope"), F.col("unit").alias("query"), "name"), docs), "edges")
    roots = targets.select(F.col("query").alias("src"))
    closure = graph.reachable(e, roots)
    back = graph.reachable(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), roots)
    hidden = back.select(F.col("src").alias("target"), F.col("dst").alias("unit")).unionByName(_alike(spark, d, coded))
    listed = lambda df, name: df.groupBy(F.col("target").alias("query")).agg(F.collect_set("unit").alias(name))
    weighted, avg = contexts.weighted(docs, targets)
    flags = weighted.join(listed(hidden, "hidden"), "query", "left").join(listed(closure.select(F.col("src").alias("target"), F.col("dst").alias("unit")), "needed"), "query", "left")
    return scratch.cut(flags.withColumns({c: F.coalesce(c, F.array().cast("array<bigint>")) for c in ("hidden", "needed")}), "targets"), docs, avg, closure


def ranked_arm(spark, d):
    """The universe of each target by ascending score: the best unit stands last, nearest to the target."""
    targets, docs, avg, _ = _contexts(spark, d)
    return contexts.ranked(targets.drop("needed"), docs, avg)


def _arms(spark: SparkSession, d: str) -> DataFrame:
    """arm, seed, target, unit, size, place, the nearest to the target first, and the bytes up to there."""
    m = _marked(spark, d, scored=True)
    shown = m.where(_SHOWN)
    base = ["arm", "seed", "target", "unit", "size"]

    def placed(rows: DataFrame, *order) -> DataFrame:
        w = Window.partitionBy("arm", "seed", "target").orderBy(*order)
        return rows.select(*base, F.row_number().over(w).alias("place"), F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))

    none = F.lit(None).cast("int").alias("seed")
    k4 = placed(m.where("hops is not null").select(F.lit("k4").alias("arm"), none, "target", "unit", "size", "hops"), "hops", "unit")
    k5 = placed(shown.where("hops is null").select(F.lit("k5").alias("arm"), F.explode(F.array(*map(F.lit, SEEDS))).alias("seed"), "target", "unit", "size"), priority("k5", "seed", "target", "unit"), "unit")
    k6 = placed(shown.select(F.lit("k6").alias("arm"), none, "target", "unit", "size", "score"), F.desc("score"), priority("k6tie", "target", "unit"), "unit")
    return k4.unionByName(k5).unionByName(k6)


MEMBERS = 20


def arm_members(spark, d):
    """The 20 units nearest to each target in the closure, the random and the ranked arm."""
    targets, docs, avg, closure = _contexts(spark, d)
    best = Scratch(spark).cut(contexts.nearest(targets, docs, avg, SEEDS, MEMBERS), "nearest")

    def first(rows: DataFrame, arm: str, seed, *order) -> DataFrame:
        w = Window.partitionBy("seed", "target").orderBy(*order)
        return rows.withColumn("seed", seed).withColumn("place", F.row_number().over(w)).where(F.col("place") <= MEMBERS).select(F.lit(arm).alias("arm"), "seed", "target", "unit", "place")

    none = F.lit(None).cast("int")
    k4 = first(closure.where("src <> dst").select(F.col("src").alias("target"), F.col("dst").alias("unit"), "dist"), "k4", none, "dist", "unit")
    k5 = first(best.where("arm = 5"), "k5", F.col("seed"), priority("k5", "seed", "target", "unit"), "unit")
    k6 = first(best.where("arm = 6"), "k6", none, F.desc("score"), priority("k6tie", "target", "unit"), "unit")
    return k4.unionByName(k5).unionByName(k6)


def arm_budgets(spark, d):
    """What of each arm fits each budget, cut at the far end: bytes, whole units, units cut, bytes of whole units alone, whether the budget is filled."""
    size, before = F.col("size"), F.col("upto") - F.col("size")

    def fits(budget: int) -> list:
        inside = F.greatest(F.least(budget - before, size), F.lit(0))
        whole = inside == size
        return [
            F.sum(inside).alias("bytes"), F.count_if(whole).alias("whole"), F.count_if((inside > 0) & ~whole).alias("cut"), F.coalesce(F.sum(F.when(whole, size)), F.lit(0)).cast("bigint").alias("whole_bytes"), (F.max("upto") >= budget).alias("filled")
        ]

    sums = _arms(spark, d).groupBy("arm", "seed", "target").agg(*[F.struct(F.lit(b).alias("budget"), *fits(b)).alias(f"b{b}") for b in A.BUDGETS])
    return sums.select("arm", "seed", "target", F.explode(F.array(*[f"b{b}" for b in A.BUDGETS])).alias("b")).select("arm", "seed", "target", "b.*")


QUERIES = {"ranked_arm": ranked_arm, "unit_references": unit_references, "arm_universe": arm_universe, "arm_members": arm_members, "arm_budgets": arm_budgets}

_E = f"""{_SETS}, au AS (SELECT unit_id AS unit, min(repo) AS repo, min(relpath) AS path, min(json_extract_string(identity, '$[1]')) AS name, cast(min(octet_length(encode(regexp_replace(payload, chr(10) || '+$', '') || chr(10)))) AS BIGINT) AS size,
    min(list_sort(list_distinct(regexp_extract_all(payload, '[A-Za-z_][A-Za-z0-9_]*')))) AS words FROM units WHERE unit_id IS NOT NULL AND payload IS NOT NULL AND repo IS NOT NULL GROUP BY unit_id),
  aw AS (SELECT unit, repo, unnest(words) AS term FROM au), ae AS (SELECT DISTINCT aw.unit AS src, n.unit AS dst FROM aw JOIN au n ON n.repo = aw.repo AND n.name = aw.term WHERE n.unit <> aw.unit)"""
_A = f"""{_E}, fw AS (SELECT src, dst, 1 AS dist FROM ae WHERE src % 50 = 0 UNION SELECT f.src, e.dst, f.dist + 1 FROM fw f JOIN ae e ON e.src = f.dst WHERE f.dist < (SELECT count(*) FROM au)),
  cz AS (SELECT src, dst, min(dist) AS hops FROM fw GROUP BY src, dst), bw AS (SELECT dst AS src, src AS dst FROM ae WHERE dst % 50 = 0 UNION SELECT b.src, e.src FROM bw b JOIN ae e ON e.dst = b.dst),
  nl AS (SELECT a, b FROM j UNION ALL SELECT hub, unit_id FROM (SELECT min(unit_id) OVER (PARTITION BY verb) AS hub, unit_id FROM h) WHERE hub <> unit_id UNION ALL SELECT hub, unit_id FROM (SELECT min(unit_id) OVER (PARTITION BY norm) AS hub, unit_id FROM h) WHERE hub <> unit_id),
  nd AS (SELECT a, b FROM nl UNION SELECT b, a FROM nl),
  am AS (SELECT t.unit AS target, w.unit, w.size, cz.hops, coalesce(w.path = t.path, false) AS same_file, bw.src IS NOT NULL AS dependent, nd.a IS NOT NULL AS near FROM au t JOIN au w ON w.repo = t.repo AND w.unit <> t.unit AND t.unit % 50 = 0
    LEFT JOIN cz ON cz.src = t.unit AND cz.dst = w.unit LEFT JOIN bw ON bw.src = t.unit AND bw.dst = w.unit LEFT JOIN nd ON nd.a = t.unit AND nd.b = w.unit),
  sh AS (SELECT * FROM am WHERE NOT (same_file OR dependent OR near))"""
_ARMS = f"""{_A}, sz AS (SELECT unit AS id, len(words) AS size FROM au), st AS (SELECT count(*) AS n, avg(size) AS av FROM sz), df AS (SELECT term, count(*) AS df FROM aw GROUP BY term),
  sc AS (SELECT q.unit AS target, p.unit, cast(sum(cast(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (1 - 0.75 + 0.75 * size / av)), 9) AS DECIMAL(28,9))) AS DOUBLE) AS score FROM aw q JOIN df ON df.term = q.term JOIN aw p ON p.term = q.term JOIN sz ON sz.id = p.unit, st
    WHERE q.unit % 50 = 0 AND p.unit <> q.unit GROUP BY q.unit, p.unit),
  ar AS (SELECT 'k4' AS arm, cast(NULL AS INT) AS seed, target, unit, size, row_number() OVER (PARTITION BY target ORDER BY hops, unit) AS place FROM am WHERE hops IS NOT NULL
    UNION ALL SELECT 'k5', seed, target, unit, size, row_number() OVER (PARTITION BY seed, target ORDER BY sha256('k5:' || seed || ':' || target || ':' || unit), unit) FROM sh, (VALUES (0), (1), (2)) s(seed) WHERE hops IS NULL
    UNION ALL SELECT 'k6', NULL, sh.target, sh.unit, sh.size, row_number() OVER (PARTITION BY sh.target ORDER BY coalesce(score, 0) DESC, sha256('k6tie:' || sh.target || ':' || sh.unit), sh.unit) FROM sh LEFT JOIN sc ON sc.target = sh.target AND sc.unit = sh.unit)"""

ORACLE = {
    "unit_references": f"WITH {_E} SELECT src, dst FROM ae",
    "arm_universe": f"""WITH RECURSIVE {_A} SELECT target, count(*) AS all_units, count(*) FILTER (WHERE same_file) AS same_file, count(*) FILTER (WHERE near) AS near, count(*) FILTER (WHERE dependent) AS dependents,
      count(*) FILTER (WHERE NOT (same_file OR dependent OR near)) AS universe, count(*) FILTER (WHERE hops IS NOT NULL) AS closure, count(*) FILTER (WHERE NOT (same_file OR dependent OR near) AND hops IS NULL) AS pool FROM am GROUP BY target""",
    "ranked_arm": f"WITH RECURSIVE {_ARMS} SELECT sh.target, sh.unit, cast(row_number() OVER (PARTITION BY sh.target ORDER BY coalesce(score, 0), sha256('k6tie:' || sh.target || ':' || sh.unit) DESC, sh.unit) AS INT) AS position FROM sh LEFT JOIN sc ON sc.target = sh.target AND sc.unit = sh.unit",
    "arm_members": f"WITH RECURSIVE {_ARMS} SELECT arm, seed, target, unit, cast(place AS INT) AS place FROM ar WHERE place <= 20",
    "arm_budgets": f"""WITH RECURSIVE {_ARMS}, b AS (SELECT ar.*, budget, sum(size) OVER (PARTITION BY arm, seed, target, budget ORDER BY place ROWS UNBOUNDED PRECEDING) AS upto FROM ar, (VALUES {", ".join(f"({b})" for b in A.BUDGETS)}) v(budget)),
      c AS (SELECT *, greatest(least(budget - (upto - size), size), 0) AS inside FROM b)
      SELECT arm, seed, target, budget, cast(sum(inside) AS BIGINT) AS bytes, count(*) FILTER (WHERE inside = size) AS whole, count(*) FILTER (WHERE inside > 0 AND inside < size) AS cut, cast(coalesce(sum(size) FILTER (WHERE inside = size), 0) AS BIGINT) AS whole_bytes, max(upto) >= budget AS filled FROM c GROUP BY arm, seed, target, budget""",
}
