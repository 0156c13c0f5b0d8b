"""Scores of pairs in blocks against the plain joins, and what the arms take from them."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import blocks
from tessella.operators import similarity as S
from tessella.plans import arms


@pytest.fixture
def small(monkeypatch):
    """Several blocks on both sides, several slices in each."""
    for name, value in {"SMALL": 16, "LARGE": 20, "QUERIES": 3, "TOP_QUERIES": 4, "CELLS": 40, "MEETINGS": 30}.items():
        monkeypatch.setattr(blocks, name, value)


def _docs(spark, scopes=1):
    rnd = random.Random(11)
    rows = [(i % scopes, i, [1, 2, *(rnd.choice((rnd.randrange(8), rnd.randrange(90))) for _ in range(rnd.randrange(1, 25)))]) for i in range(90)]
    rows += [(0, i, rows[4][2]) for i in range(90, 96)] + [(0, 96, [])]  # twins, which tie, and a text without words
    return spark.createDataFrame(rows, "scope int, id bigint, items array<bigint>").repartition(3)


def _plain(docs):
    posts = docs.select("id", F.explode("items").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))
    q = posts.where("id % 5 = 0").select(F.col("id").alias("query"), "term", F.col("tf").alias("qtf"))
    return S.bm25(q, posts, posts.groupBy("id").agg(F.sum("tf").alias("size")))


def _rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_the_best_in_blocks_are_the_best_of_all(spark, small):
    docs = _docs(spark)
    want = _rows(S.top_k(_plain(docs), 10), "query", "id", "place", "score")
    assert _rows(S.top_k(blocks.bm25(docs, "id % 5 = 0", top=10), 10), "query", "id", "place", "score") == want and len(want) == 10 * len({r[0] for r in want})


def test_dense_items_change_no_score(spark, small, monkeypatch):
    docs = _docs(spark)
    run = lambda: _rows(S.top_k(blocks.bm25(docs, "id % 5 = 0", top=3), 3), "query", "id", "place", "score")
    with_dense = run()
    monkeypatch.setattr(blocks, "DENSE", 2)
    assert run() == with_dense


def test_scores_of_a_scope_are_those_of_all(spark, small):
    docs = _docs(spark, scopes=3)
    scope = docs.select("id", "scope")
    pairs = _plain(docs).join(scope, "id").join(scope.select(F.col("id").alias("query"), F.col("scope").alias("s")), "query").where("s = scope")
    want = _rows(pairs, "query", "id", "score")
    assert want and _rows(blocks.bm25(docs, "id % 5 = 0"), "query", "id", "score") == want


def test_overlaps_against_brute_force(spark, small):
    sets = _docs(spark, scopes=2).withColumn("items", F.array_distinct("items")).where(F.size("items") > 0)
    rows = [(r["scope"], r["id"], set(r["items"])) for r in sets.collect()]
    want = sorted((a, b, len(x & y), len(x | y)) for s, a, x in rows for t, b, y in rows if s == t and a != b and a % 5 == 0 and len(x & y) * 10 >= len(x | y) * 4 and x & y)
    assert want and _rows(blocks.overlaps(sets.where("id % 5 = 0").withColumnRenamed("id", "query"), sets, 4, 10), "query", "id", "n_inter", "n_union") == want


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Two repos whose units have all words but one in common; copies, and a unit that differs little from its neighbour."""
    d = str(tmp_path_factory.mktemp("arms"))
    text = "def f(a, b):\n    c = a + b\n    for k in range(c):\n        d = k * b\n    return d\n"
    rows = [(i, f"r{i % 2}", f"p{i}", f'["x","n{i}"]', text + f"z{i} = " + " ".join(f"w{i % 7} + {j}" for j in range(i % 9)) + "\n") for i in range(200)]
    rows += [(300, "r0", "p300", '["x","n300"]', rows[100][4]), (301, "r0", "p301", '["x","n301"]', rows[100][4] + "q\n"), (302, "r0", "p302", '["x","n302"]', rows[100][4].replace("z100", "y"))]
    spark.createDataFrame([(*r, "python") for r in rows], "unit_id bigint, repo string, relpath string, identity string, payload string, lang string").write.parquet(f"{d}/units.parquet")
    return d


def test_budgets_score_no_pair_of_two_repos(spark, folder):
    u = arms._units(spark, folder)
    repo = {r["unit"]: r["repo"] for r in u.collect()}
    got = _rows(arms._scores(u), "target", "unit")
    assert got and all(repo[a] == repo[b] and a != b for a, b in got)
    same = lambda rows: sorted((a, b) for a, b in rows if repo[a] == repo[b])
    whole = arms.texts.near_dup_adjacency(spark, folder).where("a % 50 = 0")
    near = same(_rows(arms._near(spark, folder, u), "target", "unit"))
    assert near == same(_rows(whole, "a", "b")) and (100, 300) in near and (100, 302) in near


@pytest.fixture
def no_pairs_of_all(monkeypatch):
    """The joins that meet every unit with every other may not be used."""

    def fail(*_):
        raise AssertionError("pairs of all units")

    for place, name in ((S, "bm25"), (S, "jaccard_pairs"), (arms.texts, "near_dup_adjacency")):
        monkeypatch.setattr(place, name, fail)


def test_ranked_arm_orders_the_universe_by_score(spark, folder, no_pairs_of_all):
    score = {(r["target"], r["unit"]): r["score"] for r in arms._scores(arms._units(spark, folder)).collect()}
    got = _rows(arms.ranked_arm(spark, folder), "target", "position", "unit")
    by = {t: [(p, u) for x, p, u in got if x == t] for t in {r[0] for r in got}}
    assert set(by) == {0, 50, 100, 150, 300}
    for t, rows in by.items():
        assert [p for p, _ in rows] == list(range(1, len(rows) + 1))
        order = [score[t, u] for _, u in rows]
        assert order == sorted(order)
    assert not {(100, 300), (100, 302), (300, 100)} & {(t, u) for t, rows in by.items() for _, u in rows}


def test_arm_members_are_the_nearest_of_each_arm(spark, folder, no_pairs_of_all):
    ranked = {}
    for t, p, u in _rows(arms.ranked_arm(spark, folder), "target", "position", "unit"):
        ranked.setdefault(t, []).append(u)
    got = _rows(arms.arm_members(spark, folder).where("arm = 'k6'"), "target", "place", "unit")
    score = {(r["target"], r["unit"]): r["score"] for r in arms._scores(arms._units(spark, folder)).collect()}
    for t, units in ranked.items():
        mine = [u for x, _, u in got if x == t]
        assert len(mine) == min(20, len(units)) and [score[t, u] for u in mine] == [score[t, u] for u in units[::-1][:20]]
    seeds = arms.arm_members(spark, folder).where("arm = 'k5'").groupBy("target", "seed").agg(F.max("place").alias("most"), F.count(F.lit(1)).alias("n")).collect()
    assert len(seeds) == 3 * len(ranked) and all(r["most"] == r["n"] == min(20, len(ranked[r["target"]])) for r in seeds)
