"""The ranked arm and the nearest units against SQL, without a table of pairs."""

import os

import pytest

from tessella.operators import contexts
from tessella.plans import arms
from tessella.scratch import Scratch
from tests.oracle import same

COLUMNS = "unit_id bigint, repo string, relpath string, identity string, payload string, lang string"
TEXT = "def f(a, b):\n    c = a + b\n    for k in range(c):\n        d = k * b\n    return d\n"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """References and cycles, copies in one repo and in two, units with several rows, empty texts, nulls, ties."""
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, f"r{i % 2}", f"p{i // 4}", f'["x","n{i}"]', f"{TEXT}n{i + 2 if i % 6 < 4 else i - 4} + n{i % 50} + w{i % 7}\n") for i in range(110)]
    rows += [(200 + i, "r0", f"q{i}", f'["x","m{i}"]', TEXT + " ".join(f"z{k}" for k in range(i))) for i in range(12)]
    rows += [(i, "r1", None, None, "") for i in (250, 251)] + [(i, "r0", None, '["x"]', "1 + 2\n") for i in (300, 301)] + [(302, None, "p0", '["x","n4"]', rows[50][4]), (303, "r0", "e", None, None)]
    rows += [(50, "r0", "p9", '["x","aa"]', "zz = n4\n"), (4, "r1", "p0", '["x","n0"]', "aa = n50 + n100\n"), (8, None, "a", '["x","a"]', "a = 1\n"), (12, "r0", "p3", '["x","n12"]', None)]
    rows += [(350, "r0", "c", '["x","n350"]', rows[100][4]), (351, "r1", "c", '["x","n351"]', rows[100][4]), (352, "r0", "h", '["x","n352"]', rows[100][4] + "q\n"), (353, "r0", "i", '["x","n353"]', rows[100][4].replace("n50", "y"))]
    spark.createDataFrame([(*r, "python") for r in rows], COLUMNS).repartition(3).write.parquet(f"{d}/units.parquet")
    return d


@pytest.fixture(scope="module")
def plain(spark, tmp_path_factory):
    """A repo of which every other unit is a target, so there are many more pairs than units."""
    d = str(tmp_path_factory.mktemp("plain"))
    rows = [(25 * i, "r", f"p{i}", f'["x","n{i}"]', f"a = {i} + b\n" + " ".join(f"{c}{i}" for c in "ghijklmopqrstuvwxyzGHIJKLMNOPQRSTUV"), "python") for i in range(60)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{d}/units.parquet")
    return d


@pytest.fixture
def tables(monkeypatch):
    """Rows of every intermediate table."""
    sizes, cut = [], Scratch.cut

    def counted(self, df, name="t"):
        out = cut(self, df, name)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "cut", counted)
    return sizes


def _against_sql(spark, folder, name):
    d = f"{folder}/sql"  # the SQL side reads single files
    if not os.path.exists(d):
        os.makedirs(d)
        spark.read.parquet(f"{folder}/units.parquet").toPandas().convert_dtypes().to_parquet(f"{d}/units.parquet")
    same(spark, arms.QUERIES[name], arms.ORACLE[name], d)


def test_ranked_arm_equals_sql_on_odd_units(spark, odd):
    _against_sql(spark, odd, "ranked_arm")


def test_ranked_arm_writes_no_table_of_pairs_and_sorts_none(spark, plain, tables):
    out = arms.ranked_arm(spark, plain)
    assert out.count() == 30 * 59 and max(tables) <= 60
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "sha2" not in plan


def test_large_scopes_are_ranked_alike(spark, odd, monkeypatch):
    monkeypatch.setattr(contexts, "PAIRS", 40)
    for whole, large in ((90, 25), (1, 7)):  # one scope in blocks, then all
        monkeypatch.setattr(contexts, "WHOLE", whole)
        monkeypatch.setattr(contexts, "LARGE", large)
        _against_sql(spark, odd, "ranked_arm")


def test_arm_members_equal_sql_on_odd_units_in_several_blocks(spark, odd, monkeypatch):
    monkeypatch.setattr(contexts, "LARGE", 30)
    _against_sql(spark, odd, "arm_members")


def test_arm_members_write_no_table_of_pairs(spark, plain, tables):
    assert arms.arm_members(spark, plain).where("arm = 'k6'").count() == 30 * 20
    pairs = 30 * 59
    assert sorted(tables)[-2] <= 60 and max(tables) == 4 * 30 * 20 > pairs  # the largest has the nearest of each order


def test_candidates_miss_no_pair_alike(spark, odd):
    """Sets of which one is all but some grams of the other, around the ratio and sizes at its ends."""
    n = lambda k: " ".join(f"t{i}" for i in range(k))
    texts = [(50 * k, n(s)) for k, s in enumerate((24, 30, 31, 40, 57, 58, 80), 1)] + [(1000 + s, n(s)) for s in range(20, 120)] + [(2000 + s, n(s) + " x") for s in range(20, 120)]
    rows = spark.createDataFrame([(u, "r", 0, None, p, None) for u, p in texts], "unit bigint, repo string, file bigint, name string, payload string, other string")
    grams = {u: {tuple(p.split()[i : i + 5]) for i in range(len(p.split()) - 4)} for u, p in texts}
    want = {(a, b) for a in grams for b in grams if a % 50 == 0 and a != b and len(grams[a] & grams[b]) * 10 >= len(grams[a] | grams[b]) * 7}
    sets = contexts.coded(rows).selectExpr("repo as scope", "unit as id", "n", "grams as items")
    got = {(r["query"], r["id"]) for r in contexts.likely(sets.where("id % 50 = 0").withColumnRenamed("id", "query"), sets, 7, 10).collect()}
    assert want and want <= got
