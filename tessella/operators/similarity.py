"""Typed records of texts, 5-gram sets, exact set-similarity joins, collisions, packs, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.joins import HOT_ROWS, split_join
from tessella.scratch import Scratch

# Length of a gram, least number of records, the ratio 7/10 and the bins above it.
GRAM = 5
LEAST_RECORDS = 20
NUM, DEN = 7, 10
BINS = ((70, "B1"), (75, "B2"), (80, "B3"), (85, "B4"), (90, "B5"))
TOKEN = r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]"


def records(text: str) -> F.Column:
    """Tokens of a text: words, numbers and single signs; white space is dropped, null gives none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def kind_of(token) -> F.Column:
    return F.when(token.rlike("^[A-Za-z_]"), "WORD").when(token.rlike("^[0-9]"), "NUM").otherwise("OP")


def grams(tokens: str) -> F.Column:
    """Distinct runs of GRAM records, joined by blanks; none for shorter texts."""
    n = F.size(tokens) - (GRAM - 1)
    runs = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(tokens, k, F.lit(GRAM)), " "))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def verbatim_hash(tokens: str) -> F.Column:
    return F.sha2(F.array_join(tokens, " "), 256)


def normalized(tokens: str) -> F.Column:
    """Records with each word replaced by the rank of its first appearance."""
    words = F.array_distinct(F.filter(tokens, lambda t: t.rlike("^[A-Za-z_]")))
    ranked = lambda ws: F.transform(tokens, lambda t: F.when(t.rlike("^[A-Za-z_]"), F.concat(F.lit("#"), F.array_position(ws, t).cast("string"))).otherwise(t))
    return F.get(F.transform(F.array(words), ranked), F.lit(0))  # as a bound variable the words are found once a text, not once a record


def meets(inter, union, num: int = NUM, den: int = DEN) -> F.Column:
    """inter / union >= num / den in whole numbers."""
    return inter * den >= union * num


def ratio_bin(inter, union) -> F.Column:
    out = F.lit(None).cast("string")
    for least, name in BINS:
        out = F.when(inter * 100 >= union * least, name).otherwise(out)
    return out


def jaccard_pairs(sets: DataFrame, key: str, grams_col: str, num: int = NUM, den: int = DEN) -> DataFrame:
    """All pairs a < b of keys whose gram sets have at least num/den of their union in common.

    Exact prefix filter: grams are ordered by (document frequency, hash); sets
    that are alike share a gram among their first size - ceil(size num / den)
    + 1. Equal sets are one class, so a group of copies doesn't meet itself:
    the result has pairs of class representatives (their least keys);
    ``classes`` has the membership. Columns ``a, b, n_inter, n_union``. Empty
    sets are alike to nothing.
    """
    scratch = Scratch(sets.sparkSession)
    hashed = sets.select(F.col(key).alias("id"), F.array_sort(F.transform(grams_col, lambda g: F.xxhash64(g))).alias("g")).where(F.size("g") > 0)
    reps = hashed.groupBy("g").agg(F.min("id").alias("id")).select("id", "g", F.size("g").alias("n"))
    reps = scratch.cut(reps, "reps")
    flat = reps.select("id", "n", F.explode("g").alias("h"))
    freq = flat.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    w = Window.partitionBy("id").orderBy("df", "h")
    lead = F.col("n") - F.expr(f"(n * {num} + {den - 1}) div {den}") + 1
    ranked = flat.join(freq, "h", "left").withColumn("df", F.coalesce("df", F.lit(1))).withColumn("r", F.row_number().over(w))
    prefix = ranked.where((F.col("r") <= lead) & (F.col("df") > 1)).select("h", "id", "n")
    x, y = prefix.alias("x"), prefix.alias("y")
    close = (F.col("x.h") == F.col("y.h")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.n") * den >= F.col("y.n") * num) & (F.col("y.n") * den >= F.col("x.n") * num)
    cand = scratch.cut(x.join(y, close).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "cand")
    both = cand.join(reps.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a").join(reps.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b")
    inter = F.size(F.array_intersect("ga", "gb"))
    sized = both.select("a", "b", inter.alias("n_inter"), (F.size("ga") + F.size("gb") - inter).alias("n_union"))
    return sized.where(meets(F.col("n_inter"), F.col("n_union"), num, den))


def classes(sets: DataFrame, key: str, grams_col: str) -> DataFrame:
    """id, class_id: sets that are equal share the class named by their least key."""
    hashed = sets.select(F.col(key).alias("id"), F.array_sort(F.transform(grams_col, lambda g: F.xxhash64(g))).alias("g")).where(F.size("g") > 0).withColumn("h", F.xxhash64("g"))
    least = hashed.groupBy("h", "g").agg(F.min("id").alias("class_id")).select("h", "g", "class_id")
    return hashed.join(least, ["h", "g"]).select("id", "class_id")


def collisions(units: DataFrame, scope: list[str], norm: str, verb: str) -> DataFrame:
    """Normalised hashes shared by units with different verbatim hashes."""
    return units.groupBy(*scope, norm).agg(F.count(F.lit(1)).alias("members"), F.count_distinct(verb).alias("verbatims"), F.max("n_records").alias("n_records")).where("verbatims >= 2").withColumn("band", F.when(F.col("n_records") < LEAST_RECORDS, "under20").otherwise("geq20"))


def member_pair(units: DataFrame, groups: DataFrame, scope: list[str], norm: str, verb: str, key: str, order) -> DataFrame:
    """Of each collision the member of lowest seeded hash and the next one with another verbatim hash."""
    rows = units.join(groups.select(*scope, norm), [*scope, norm]).withColumn("rank_hash", order)
    first = rows.groupBy(*scope, norm).agg(F.min(F.struct("rank_hash", key, verb)).alias("f"))
    rest = rows.join(first, [*scope, norm]).where(F.col(verb) != F.col(f"f.{verb}"))
    return rest.groupBy(*scope, norm).agg(F.max(F.col(f"f.{key}")).alias("left_id"), F.min(F.struct("rank_hash", key))[key].alias("right_id"))


def adjacency(units: DataFrame, pairs: DataFrame, key: str, verb: str, norm: str) -> DataFrame:
    """``a, b, reasons``: units that are verbatim twins, normalised twins or alike (``pairs`` a, b), in both directions.

    Twins are linked to the first of their kind, which keeps a group of copies
    linear. Null hashes are no twins.
    """
    hub = lambda c: units.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(key).alias("hub"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    star = lambda c: split_join(units.select(key, c), hub(c), [c]).where(F.col("hub") != F.col(key)).select(F.col("hub").alias("a"), F.col(key).alias("b"))
    one = star(verb).unionByName(star(norm)).unionByName(pairs.select("a", "b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("reasons"))
    return one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b"), "reasons"))


def bm25(queries: DataFrame, postings: DataFrame, sizes: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Scores of all (query, document) pairs with a term in common.

    ``queries``: query, term, qtf; ``postings``: id, term, tf; ``sizes``: id,
    size. idf = ln(1 + (N - df + .5) / (df + .5)); query frequency counts
    linearly. Sums are exact decimals of the rounded parts, independent of
    order.
    """
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg")).first()
    n, avg = total["n"], total["avg"] or 1.0
    terms = queries.select("term").distinct()
    mine = postings.join(terms, "term", "left_semi")
    # a term of many documents is cut into parts, to each of which its queries go
    df = mine.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("parts", F.ceil(F.col("df") / HOT_ROWS))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = queries.join(df, "term").withColumn("w", F.col("qtf") * idf).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    mine = split_join(mine, df.select("term", "parts"), ["term"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    norm = k1 * (1 - b + b * F.col("size") / avg)
    hits = weighted.join(mine, ["term", "part"]).join(sizes, "id").where("id <> query")
    part = F.round(F.col("w") * F.col("tf") * (k1 + 1) / (F.col("tf") + norm), 9)
    return hits.groupBy("query", "id").agg(F.sum(part.cast("decimal(28,9)")).cast("double").alias("score"))


def top_k(scores: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scores.withColumn("place", r).where(F.col("place") <= k)
