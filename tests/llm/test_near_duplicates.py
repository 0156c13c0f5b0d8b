import random

import pytest

from tessella.llm import near_duplicates as nd
from tessella.llm.near_duplicates_queries import p2_found


def words(text):
    return frozenset(nd.WORD.findall(text))


def alike(a, b):
    u = len(a | b)
    return u > 0 and 10 * len(a & b) >= 7 * u


def corpus(seed, n=220):
    """Texts with shared frequent words, edited copies, exact copies and tiny ones."""
    rnd = random.Random(seed)
    common = [f"kw{i}" for i in range(12)]
    texts = []
    for i in range(n):
        if texts and rnd.random() < 0.5:
            base = list(nd.WORD.findall(rnd.choice(texts)))
            for _ in range(rnd.randrange(0, max(1, len(base) // 3))):
                k = rnd.randrange(len(base) + 1)
                if rnd.random() < 0.5 and base:
                    base.pop(min(k, len(base) - 1))
                else:
                    base.insert(k, f"e{rnd.randrange(400)}")
            rnd.shuffle(base)
        else:
            base = [f"w{rnd.randrange(900)}" for _ in range(rnd.choice([0, 1, 2, 3, 5, 9, 20, 40, 80]))] + rnd.sample(common, rnd.randrange(12))
        texts.append(" ".join(base))
    return texts


@pytest.mark.parametrize(("seed", "frequent", "most", "block"), [(1, 0.001, 100_000, 2_000), (2, 0.3, 100_000, 7), (3, 0.02, 5, 3)])
def test_no_link_is_lost(spark, seed, frequent, most, block, monkeypatch):
    monkeypatch.setattr(nd, "FREQUENT", frequent)
    monkeypatch.setattr(nd, "MOST_FREQUENT", most)
    monkeypatch.setattr(nd, "BLOCK", block)
    texts = corpus(seed)
    sets = {i: words(t) for i, t in enumerate(texts)}
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string").repartition(3)
    members, links = nd.near_duplicates(df, "id", "t")
    cls = {r["id"]: r["class_id"] for r in members.collect()}
    for i, s in sets.items():
        same = [j for j, x in sets.items() if x == s and (s or texts[i] == texts[j])]
        assert cls[i] == min(same)
    reps = sorted({cls[i] for i in sets})
    want = {(a, b) for a in reps for b in reps if a < b and alike(sets[a], sets[b])}
    assert {(r["class_a"], r["class_b"]) for r in links.collect()} == want
    assert len(want) > 20


def test_copies_beyond_the_limit_meet_once(spark, monkeypatch):
    monkeypatch.setattr(nd, "HOT", 5)
    rows = [(i, "a b c d e f g h i j") for i in range(40)] + [(100, "a b c d e f g h i k"), (101, "x y z")]
    members, links = nd.near_duplicates(spark.createDataFrame(rows, "id bigint, t string"), "id", "t")
    assert {(r["class_a"], r["class_b"]) for r in links.collect()} == {(0, 100)}
    assert members.where("class_id = 0").count() == 40


def test_pairs_of_a_large_class_are_all_listed(spark, tmp_path):
    n = 1_150
    rows = [(i, "a b c d e f g h i j" if i % 2 else f"j i h g{' ' * (i % 5 + 1)}f e d c b a") for i in range(n)] + [(n, "a b c d e f g h i k"), (n + 1, "x y z"), (n, "a b c d e f g h i k")]
    spark.createDataFrame(rows, "unit_id bigint, payload string").write.parquet(str(tmp_path / "units.parquet"))
    got = [tuple(r) for r in p2_found(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for b in range(n + 1) for a in range(b)}


def test_nulls_repeats_long_texts_and_other_columns(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None, "x"), (None, "a b c", "x"), (2, "", "x"), (3, "", "x"), (4, "!!", "x"), (5, "a b c", "x"), (5, "a b c", "x"), (6, long, "x"), (7, long + " more", "x")]
    df = spark.createDataFrame(rows, "id bigint, t string, words string")
    members, links = nd.near_duplicates(df, "id", "t")
    assert {r["id"]: r["class_id"] for r in members.collect()} == {2: 2, 3: 2, 4: 4, 5: 5, 6: 6, 7: 7}
    assert {(r["class_a"], r["class_b"]) for r in links.collect()} == {(6, 7)}
    members, links = nd.near_duplicates(df.limit(0), "id", "t")
    assert members.count() == 0 and links.count() == 0


def test_limit_is_included():
    a, b = words("a b c d e f g h"), words("a b c d e f g x y")
    assert alike(a, b) and len(a & b) == 7 and len(a | b) == 10
