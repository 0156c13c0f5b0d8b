"""Audits, typed records and arms on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.functions import lexers
from tessella.operators import audits, similarity

PY = "def f(a, b):\n    # sum\n    c = a + b\n    return c * 2\n"


def test_comments_and_blank_lines_do_not_count_but_nesting_does():
    p = lexers.fingerprint(PY, "python")
    assert p["verbatim"] == lexers.fingerprint(PY.replace("    # sum\n", "\n\n"), "python")["verbatim"]
    nested = lexers.fingerprint("if x:\n    a = 1\n    b = 2\n", "python"), lexers.fingerprint("if x:\n    a = 1\nb = 2\n", "python")
    assert nested[0]["verbatim"] != nested[1]["verbatim"] and nested[0]["grams"] == nested[1]["grams"]


def test_renamed_units_collide_only_when_normalised():
    p, q = lexers.fingerprint(PY, "python"), lexers.fingerprint(PY.replace("c", "total").replace("a", "x"), "python")
    assert p["verbatim"] != q["verbatim"] and p["normalized"] == q["normalized"]
    other = lexers.fingerprint(PY.replace("return", "yield"), "python")
    assert other["normalized"] != p["normalized"]  # keywords keep their names
    a, b = lexers.fingerprint('s = "a  b"\n', "python"), lexers.fingerprint('s = "a b"\n', "python")
    assert a["verbatim"] != b["verbatim"] and a["normalized"] != b["normalized"]
    lean = [lexers.fingerprint(f"theorem {n} (h : {n} ≤ 2) : p := by simp\n", "lean") for n in ("foo", "bar")]
    assert lean[0]["normalized"] == lean[1]["normalized"] and lean[0]["verbatim"] != lean[1]["verbatim"]


def test_texts_that_do_not_lex_give_their_reason(spark):
    rows = [(1, PY, "python"), (2, "def f(:\n  '''", "python"), (3, None, "lean"), (4, "", "lean"), (5, "/- open", "lean"), (6, PY.replace("\n", "\r\n"), "python")]
    got = {r["id"]: r for r in lexers.fingerprint_table(spark.createDataFrame(rows, "id bigint, t string, l string"), "id", "t", "l").collect()}
    assert got[1]["verbatim"] == got[6]["verbatim"] and got[1]["error"] is None
    assert all(got[k]["error"] and got[k]["verbatim"] is None for k in (2, 3, 4, 5))


def test_pairs_of_grams_against_brute_force(spark):
    rnd = random.Random(3)
    sets = [sorted(rnd.sample(range(60), rnd.randrange(5, 30))) for _ in range(60)]
    for i in range(60, 120):
        sets.append(sorted({x if rnd.random() > 0.12 else rnd.randrange(60) for x in sets[i - 60]}))
    sets += [list(range(8)), [*range(1, 8), 90, 91], list(range(200, 284)), list(range(215, 299))]  # 7/10 is alike, 69/99 isn't
    rows = [(i, s) for i, s in enumerate(sets)]
    got = {(r["a"], r["b"]): (r["n_inter"], r["n_union"]) for r in similarity.jaccard_pairs(spark.createDataFrame(rows, "id bigint, g array<bigint>"), "id", "g").collect()}
    least = {tuple(s): min(i for i, x in rows if x == s) for s in sets}
    want = {}
    for a in least.values():
        for b in least.values():
            i, u = len(set(sets[a]) & set(sets[b])), len(set(sets[a]) | set(sets[b]))
            if a < b and 10 * i >= 7 * u:
                want[a, b] = (i, u)
    assert got == want and got[120, 121] == (7, 10) and (122, 123) not in got


def test_adjacency_is_symmetric_and_linear_in_copies(spark):
    u = spark.createDataFrame([(i, "v", "n") for i in range(50)] + [(60, "w", "n"), (61, "x", "m"), (62, None, None), (63, None, None)], "k bigint, v string, n string")
    p = spark.createDataFrame([(60, 61)], "a bigint, b bigint")
    got = {(r["a"], r["b"]): r["reasons"] for r in similarity.adjacency(u, p, "k", "v", "n").collect()}
    assert len(got) == 2 * (49 + 1 + 1) and got[0, 7] == 2 and got[7, 0] == 2 and got[0, 60] == 1 and got[61, 60] == 1


def test_scores_do_not_depend_on_the_parts_of_a_hot_term(spark, monkeypatch):
    rnd = random.Random(5)
    posts = [(i, t, rnd.randrange(1, 4)) for i in range(60) for t in ["all", *rnd.sample("abcdefgh", 3)]]
    p = spark.createDataFrame(posts, "id bigint, term string, tf int")
    q = p.where("id < 4").select(F.col("id").alias("query"), "term", F.col("tf").alias("qtf"))
    sizes = p.groupBy("id").agg(F.sum("tf").alias("size"))
    run = lambda: sorted((r["query"], r["id"], r["score"]) for r in similarity.bm25(q, p, sizes).collect())
    whole = run()
    monkeypatch.setattr(similarity, "HOT_ROWS", 7)
    assert run() == whole and len(whole) == 4 * 59


def test_phases_move_to_the_next_group(spark):
    g = spark.createDataFrame([("s", 0, 3), ("s", 1, 4), ("s", 2, 2), (None, 0, 1)], "s string, g int, n bigint")
    got = {(r["group"], r["phase"]): r["snapped"] for r in audits.snap(g, "s", ["g"], "n", (0, 1, 3, 8, 9, 20)).collect()}
    assert [got["s", p] for p in (0, 1, 3, 8, 9, 20)] == [0, 3, 3, 9, 9, 20] and got[None, 1] == 1


def test_context_bytes_tell_a_wrong_offset(spark):
    g = spark.createDataFrame([("c", 1, 0, 5, 10), ("c", 1, 1, 2, 15), ("c", 1, 2, 1, 99)], "cell string, win int, grp int, blen int, ctxb int")
    got = [(r["grp"], r["recomputed"], r["same"]) for r in audits.context_bytes(g, ["cell", "win"], "grp", "blen", "ctxb").orderBy("grp").collect()]
    assert got == [(0, 0, True), (1, 5, True), (2, 7, False)]


def test_blind_pairs_hide_their_roles(spark):
    p = spark.createDataFrame([(1, 2, "r1"), (1, 2, "r2"), (1, 2, "r1"), (3, 9, "r2")] + [(i, i + 1, "r1") for i in range(100, 140)], "a bigint, b bigint, role string")
    got = {frozenset((r["left_id"], r["right_id"])): r for r in audits.blind(p, "a", "b", "role", "x").collect()}
    assert len(got) == 42 and got[frozenset((1, 2))]["roles"] == ["r1", "r2"]
    swapped = sum(r["left_id"] > r["right_id"] for r in got.values())
    assert 8 < swapped < 34 and len({r["pair_id"] for r in got.values()}) == 42


def test_drift_ordinals_and_reasons(spark):
    r = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", "y"), (1, 5, "b", "z"), (2, 1, "a", "a")], "k bigint, run int, f string, g string")
    assert sorted((x["k"], x["run"], x["field"]) for x in audits.drift(r, "k", "run", ["f", "g"]).collect()) == [(1, 2, "g"), (1, 5, "f"), (1, 5, "g")]
    o = {x["run"]: (x["ordinal"], x["bindings"], x["final"]) for x in audits.ordinals(r.where("k = 1"), ["k"], ["run"]).collect()}
    assert o == {1: (0, 3, False), 2: (1, 3, False), 5: (2, 3, True)}
    paths = spark.createDataFrame([("src/a/b.py",), ("src/tests/b.py",), ("doc/b.py",), ("src/b.c",), ("src",), ("src/tests.py",)], "p string")
    why = audits.skip_reason(F.split("p", "/"), F.regexp_extract("p", r"\.(\w+)$", 1), ("src",), ("tests",), ("py",))
    assert [x["w"] for x in paths.select(why.alias("w")).collect()] == ["admitted", "excluded", "outside", "ending", "outside", "admitted"]


@pytest.mark.parametrize(("row", "want"), [(0, "protected"), (3, "protected"), (4, "excluded"), (5, "downstream"), (9, "downstream")])
def test_causal_class(spark, row, want):
    assert spark.range(1).select(audits.causal_class(F.lit(row), F.lit(5)).alias("c")).first()["c"] == want
