import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import encoding, personal_info
from tessella.llm.lexicon import Lexicon, build
from tessella.llm.mixing import mix
from tessella.llm.source_origin import code_key, layout, origins, statements, tuned
from tests.llm import planted

ODD = ["", " ", "a", "it's I'll  two  spaces\n\n\ttab ", "naïve café ☕ 日本語 👩‍💻", "<|endoftext|> <|pad|>", "x" * 5000, "ab" * 3000 + "1" * 999, "\r\n\r\n a\u00a0b", "0123456789" * 40, "don't DON'T 's", "\x00\x01", "é" * 700]


@pytest.fixture(scope="module")
def ranks():
    return encoding.read_ranks(encoding.vocabulary_path())


def test_transducer_finds_its_words_and_no_others(tmp_path):
    rnd = random.Random(1)
    words = {bytes(rnd.choice(b"abc") for _ in range(rnd.randrange(1, 9))): [rnd.randrange(50_000) for _ in range(rnd.randrange(1, 4))] for _ in range(400)}
    words |= {b"": [1], b"z" * 40: [2], "é".encode(): [3]}
    path = tmp_path / "lex"
    path.write_bytes(build(words))
    lex = Lexicon(str(path))
    asked = [*words, b"abcabcabcx", b"\0", b"ab\0"]
    got = lex.look_up(asked)
    for w, r in zip(asked, got.tolist()):
        inside = w in words and 0 < len(w) <= 32
        assert (r >= 0) == inside
        if inside:
            assert lex.ids_of(r) == words[w]
    (tmp_path / "none").write_bytes(build({}))
    assert Lexicon(str(tmp_path / "none")).look_up([b"a"]).tolist() == [-1]
    with pytest.raises(ValueError):
        (tmp_path / "bad").write_bytes(b"no")
        Lexicon(str(tmp_path / "bad"))


def test_suffixes_are_shared():
    words = {f"{a}ing".encode(): [1] for a in "bcdfghjklm"}
    assert len(build(words)) < len(build({f"{a}{a}{a}{a}".encode(): [1] for a in "bcdfghjklm"}))


def test_ids_are_those_of_the_library(spark, ranks):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lib.encode_special_tokens = True
    rows = [(i, t, "x") for i, t in enumerate(ODD * 2)] + [(900, None, "x"), (None, "a", "x"), (3, ODD[3], "x")]
    df = spark.createDataFrame(rows, "id bigint, text string, ids string")
    got = [(r["id"], r["ids"]) for r in encoding.encode(df, "id").collect()]
    want = [(i, lib.encode(t, add_special_tokens=False).ids if t else []) for i, t, _ in rows]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert encoding.encode(df.limit(0), "id").count() == 0
    counts = encoding.token_counts(df, ["id", "ids"]).collect()
    assert {r["id"]: r["n_tokens"] for r in counts} == {i: len(x) for i, x in want}
    assert b"".join({v: k for k, v in ranks.items()}[i] for i in want[4][1]).decode() == ODD[4]


def mixed(spark, docs, targets):
    d = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint, h string")
    t = spark.createDataFrame(targets, "mix_id string, source string, weight_ppm int, budget_tokens bigint, max_repeats int")
    uses, report = mix(d, t)
    return [tuple(r) for r in uses.select("mix_id", "source", "doc_id", "n_uses").collect()], {(r["mix_id"], r["source"]): r for r in report.collect()}


def test_mix_meets_its_targets(spark):
    rnd = random.Random(2)
    docs = [(i, rnd.choice([" Big", "big", "BIG "]), rnd.randrange(1, 60), "x") for i in range(600)] + [(1000 + i, "small", 10, "x") for i in range(5)] + [(2000, None, 50, "x"), (2001, " ", 50, "x"), (2002, "big", None, "x"), (2003, "one", 77, "x")]
    n = {i: t or 0 for i, _, t, _ in docs}
    targets = [("a", "big", 900_000, 4000, 3), ("a", "Small", 100_000, 4000, 4), ("b", "big", 950_000, 40_000, 5), ("b", "small", 40_000, 5_000, 2), ("b", "gone", 10_000, 40_000, 9), ("c", "one", 1_000_000, 115, 2), ("c", "one", 1_000_000, 115, 2), ("d", "big", None, None, None)]
    uses, report = mixed(spark, docs, targets)
    r = report["a", "big"]
    assert abs(r["actual_tokens"] - 3600) <= 60 and not r["short"]
    assert report["a", "Small"]["short"] and report["a", "Small"]["actual_tokens"] == 200
    assert abs(report["b", "big"]["actual_tokens"] - 38_000) <= 60
    assert report["b", "gone"]["short"] and report["b", "gone"]["actual_tokens"] == 0
    assert report["b", "small"]["short"] and report["b", "small"]["actual_tokens"] == 100
    assert report["c", "one"]["actual_tokens"] in (77, 154) and not report["c", "one"]["short"]
    for (m, s), row in report.items():
        mine = [(d, k) for a, b, d, k in uses if (a, b) == (m, s)]
        assert row["actual_tokens"] == sum(n[d] * k for d, k in mine) and len({d for d, _ in mine}) == len(mine)
        assert all(0 < k <= row["max_repeats"] for _, k in mine)
    rounds = 38_000 // sum(t or 0 for i, s, t, _ in docs if s and s.strip().lower() == "big")
    small = {d for a, b, d, _ in uses if (a, b) == ("a", "big")}
    large = {d for a, b, d, k in uses if (a, b) == ("b", "big") and k > rounds}
    assert small <= large or large <= small  # ranges from one end


@pytest.mark.parametrize("budget", [10**12, 10**13, 10**14, 9 * 10**18])
def test_mix_of_trillions_of_tokens(spark, budget):
    docs = [(i, "big", budget // 1000 + i, "x") for i in range(500)] + [(1000 + i, "small", budget // 10**6, "x") for i in range(10)]
    total = sum(n for _, s, n, _ in docs if s == "big")
    uses, report = mixed(spark, docs, [("a", "big", 900_001, budget, 2_000_000), ("a", "small", 99_999, budget, 7)])
    big, small = report["a", "big"], report["a", "small"]
    want = 900_001 * budget // 10**6
    assert not big["short"] and abs(big["actual_tokens"] - want) <= budget // 1000 + 500 and abs(big["target_tokens"] / want - 1) < 1e-9
    assert small["short"] and small["actual_tokens"] == 70 * (budget // 10**6) and big["available_tokens"] == total
    assert {k for _, s, _, k in uses if s == "big"} <= {want // total, want // total + 1}


def test_shares_reported_are_those_of_the_uses(spark):
    rnd = random.Random(3)
    docs = [(i, rnd.choice("abc"), rnd.randrange(0, 90), "x") for i in range(3000)]
    targets = [(m, s, w, b, 3) for m, b in (("m1", 40_000), ("m2", 90_000)) for s, w in (("a", 500_000), ("b", 300_000), ("c", 200_000))]
    uses, report = mixed(spark, docs, targets)
    n = {i: t for i, _, t, _ in docs}
    for (m, s), r in report.items():
        mine = sum(n[d] * k for a, b, d, k in uses if (a, b) == (m, s))
        whole = sum(n[d] * k for a, _, d, k in uses if a == m)
        weight, budget = next((w, b) for a, c, w, b, _ in targets if (a, c) == (m, s))
        assert r["actual_tokens"] == mine and r["actual_ppm"] == round(mine * 1e6 / whole)
        assert abs(r["actual_ppm"] - weight) <= 90 * 1e6 / budget


def test_mix_of_nothing(spark):
    uses, report = mixed(spark, [], [("a", "x", 1_000_000, 10, 1)])
    assert uses == [] and report["a", "x"]["short"]
    uses, report = mixed(spark, [(1, "x", 5, "h")], [])
    assert uses == [] and report == {}


HAND = "def f(x):\n    '''Sum the rows.'''\n    total = 0\n    for row in x:\n        total += row.value\n    return total\n\n\n"
THEIRS = "def g(y):\n    return [z.key for z in y if z]\n"
FILES = {
    "src/a.py": (HAND * 4, False),
    "src/long.py": (HAND * 6 + "PATTERN = re.compile('" + "|".join(["alpha_beta", "gamma_delta"] * 12) + "')\n", False),
    "src/talk.py": ("# TODO: do not edit tables in place.\n# Lists records that the runner generated earlier.\n" + HAND * 4, False),
    "src/table.py": (HAND * 5 + "T = [1, 2, 3, 44, 55]\n", False),
    "src/externals/vendor_x.py": (HAND * 4, False),
    "src/Vendor/b.py": (HAND * 4 + THEIRS, True),
    "src/near.py": ("# our own note\n\n" + (HAND * 4 + THEIRS).replace("\n", "\r\n"), True),
    "src/like.py": (HAND * 5 + THEIRS, False),
    "node_modules/x/b.py": (HAND * 2, True),
    "a/ThirdParty/b.py": (HAND * 2, True),
    "a/third-party/b.py": (HAND * 2, True),
    "_vendor/b.py": (HAND * 2, True),
    "a/Vendored/b.py": (HAND * 2, True),
    "extern/b.py": (HAND * 2, True),
    "a\\3rdparty\\b.py": (HAND * 2, True),
    "vendors_api/a.py": (HAND * 3, False),
    "third_parties_report/a.py": (HAND * 3, False),
    "internal_external_bridge/a.py": (HAND * 3, False),
    "generated_names_tests/a.py": (HAND * 3, False),
    "src/vendor": (HAND * 3, False),
    "src/gen.py": ("# Code generated by toolgen. DO NOT EDIT.\n" + HAND * 4, True),
    "src/copy.py": ("# Taken verbatim from the foo distribution.\n" + HAND * 4, True),
    "src/min.js": ("".join(f"var a{i}=b.c(d,{i});function e{i}(f){{return f?g(f):h}};" for i in range(60)), True),
    "src/data.py": ("X = [\n" + "".join(f"  {i}.{i}3, -{i}.5, {i * 7}.25,\n" for i in range(80)) + "]\n", True),
    "src/blob.py": ('B = """\n' + "\n".join("QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2" for _ in range(20)) + '\n"""\n', True),
    "src/bulk.py": (HAND * 4, True),
    "src/subject.py": (HAND * 4, True),
    "src/transport.py": (HAND * 4, False),
    "noending": (HAND * 4, False),
    "": ("", False),
}


def test_hand_written_files_remain(spark):
    commits = {"src/bulk.py": "c1", "src/subject.py": "c2", "src/transport.py": "c3"}
    rows = [(i, "r", rel, text, commits.get(rel), "x") for i, (rel, (text, _)) in enumerate(FILES.items())]
    rows += [(100 + i, "r", f"src/p{i}.py", HAND * (3 + i % 4), None, "x") for i in range(40)] + [(rows[1][0], *rows[1][1:]), (999, None, None, None, None, None), (None, "r", "a.py", HAND, None, "x")]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, rel string, text string, first_commit string, lang string")
    told = spark.createDataFrame([("c1", "Add", 100), ("c1", "Add", None), ("c2", "Ported x from y", 1), ("c3", "Transport lemma for imports", 99), (None, "Vendor x", 500)], "commit_sha string, subject string, n_files_added int")
    got = {r["file_id"]: r["not_hand_written"] for r in origins(files, told).collect()}
    for i, (rel, (_, want)) in enumerate(FILES.items()):
        assert got[i] == want, rel
    assert got[999] is False and None not in got
    assert origins(files.limit(0), told.limit(0)).count() == 0


def test_sources_of_vendored_copies_remain(spark):
    body = HAND * 3 + THEIRS
    rows = [(1, "ann/solver", "src/a.py", body, None), (2, "bob/app", "vendor/solver/a.py", "# as of June\n" + body, None), (3, "cy/tool", "lib/a.py", body, None), (4, None, "a.py", body, None), (5, "d/e", "vendor/z.py", "import z\n", None), (6, "d/f", "z.py", "import z\n", None)]
    files = spark.createDataFrame(rows, "file_id bigint, repo string, rel string, text string, first_commit string")
    told = spark.createDataFrame([], "commit_sha string, subject string, n_files_added int")
    got = {r["file_id"]: (r["vendor_path"], r["copied"]) for r in origins(files, told).collect()}
    assert got == {1: (False, False), 2: (True, False), 3: (False, True), 4: (False, True), 5: (True, False), 6: (False, False)}


def test_code_key_ignores_comments_and_blank_lines():
    body = HAND * 3
    key = code_key(body)
    assert key is not None and key == code_key("# x\n" + body.replace("\n", "  \r\n") + "\n\n// end") == code_key("/* a\n b\n*/\n" + body) == code_key("/* a */\n" + body)
    assert key != code_key(body + "x = 1") and code_key("") is None and code_key("# x\n" * 100) is None and code_key("/* " + body) is None


def test_limits_are_those_of_the_language(spark):
    line = {"cc": "  x += y.f({});\n", "lean": "  have h{} : a ∈ b := by simpa using (c.d e f) ▸ (g.h i j) ▸ (k.l m n) ▸ (o.p q r)\n", "py": "    total_{} = [row.value for row in rows if row.value is not None and row.key in keys]\n"}
    stats = ("n_chars", "max_line", "mean_line", "space", "alnum", "numeric", "encoded")
    rows = [(lang, k, *layout("".join(x.format(k * 7 + i) for i in range(20 + k % 5)))) for lang, x in line.items() for k in range(40)]
    t = {r["lang"]: r for r in tuned(spark.createDataFrame(rows, "lang string, text_key bigint, " + ", ".join(f"{c} double" for c in stats))).collect()}
    assert len({r["t_mean_line"] for r in t.values()}) > 2 and len({r["t_alnum"] for r in t.values()}) > 2 and len({r["t_max_line"] for r in t.values()}) > 2
    assert t["cc"]["t_mean_line"] < t["py"]["t_mean_line"]


def test_planted_files_are_found(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("bcdfglmnprst") + rnd.choice("aeiou") for _ in range(3))
    code = {
        "py": lambda: "".join(f"def {word()}({word()}, {word()}):\n    {word()} = {word()}.{word()}({rnd.randrange(90)})\n    return [{word()} for {word()} in {word()}]\n\n" for _ in range(rnd.randrange(4, 12))),
        "cc": lambda: "".join(f"int {word()}(const {word()}& {word()}) {{\n  auto {word()} = {word()}.{word()}({rnd.randrange(90)});\n  return {word()};\n}}\n\n" for _ in range(rnd.randrange(4, 12))),
        "js": lambda: "".join(f"function {word()}({word()}) {{\n  const {word()} = {word()}.map((v) => v + {rnd.randrange(9)});\n  return {word()};\n}}\n\n" for _ in range(rnd.randrange(4, 12))),
    }
    tight = lambda: "".join(f"{rnd.choice('abc')}&&(e={rnd.choice('fgh')}[{rnd.randrange(99)}]||0);function {rnd.choice('xyz')}(t){{return t?g(t-{rnd.randrange(9)}):t}};" for _ in range(40))
    digits = lambda: "x = [\n" + "".join("  " + ", ".join(f"{rnd.uniform(-9, 9):.6f}" for _ in range(8)) + ",\n" for _ in range(30)) + "]\n"
    runs = lambda: 'x = (\n' + "".join('  "' + "".join(rnd.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(76)) + '"\n' for _ in range(25)) + ")\n"
    rows, bad = [], set()
    for i in range(1500):
        lang, kind = rnd.choice(list(code)), rnd.choice(["hand"] * 7 + ["tight", "digits", "runs", "bundled"])
        text = {"hand": code[lang], "tight": tight, "digits": digits, "runs": runs, "bundled": code[lang]}[kind]()
        if kind == "hand" and i % 5 == 0:
            text += "words = '" + "|".join(word() for _ in range(50)) + "'\n"  # one long line
        rows.append((i, "r/q", f"{'third-party/' if kind == 'bundled' else ''}src/{word()}.{lang}", text, None))
        bad |= {i} if kind != "hand" else set()
    files = spark.createDataFrame(rows, "file_id bigint, repo string, rel string, text string, first_commit string")
    told = spark.createDataFrame([], "commit_sha string, subject string, n_files_added int")
    got = {r["file_id"] for r in origins(files, told).where("not_hand_written").collect()}
    assert len(got & bad) >= 0.98 * len(bad) and len(got - bad) <= 0.01 * len(got)


@pytest.mark.parametrize("share", [0.2, 0.4, 0.7])
@pytest.mark.parametrize("repeated", [False, True])
def test_many_bad_files_do_not_move_the_limits(spark, share, repeated):
    good, n = 60, round(60 * share / (1 - share))
    body = "".join(f"var a{i}=b.c(d,{i});function e{i}(f){{return f?g(f):h}};" for i in range(60))
    data = "X = [\n" + "".join(f"  {i}.{i}3, -{i}.5, {i * 7}.25,\n" for i in range(80)) + "]\n"
    rows = [(k, f"src/a{k}.{lang}", HAND * (3 + k % 4) + f"# {lang} {k}\n", None) for k, lang in enumerate(["js", "py"] * good)]
    rows += [(10_000 + k, f"src/m{k}.js", body * (1 if repeated else 1 + k % 3) + ("" if repeated else f"var z={k};"), None) for k in range(n)]
    rows += [(20_000 + k, f"src/d{k}.py", data + ("" if repeated else f"Y = {k}\n"), None) for k in range(n)]
    files = spark.createDataFrame(rows, "file_id bigint, rel string, text string, first_commit string")
    told = spark.createDataFrame([], "commit_sha string, subject string, n_files_added int")
    got = {r["file_id"] for r in origins(files, told).where("minified or data").collect()}
    assert got == {r[0] for r in rows if r[0] >= 10_000}


def test_one_more_file_does_not_switch_the_limits(spark):
    wide = [(k, f"src/w{k}.lean", "theorem x : " + "a + " * (14 + k % 9) + "\n" + "b\n" * (k % 2) + "lemma y : " + "c + " * (20 + k % 5) + f"{k}\n", None) for k in range(300)]
    own = [(1_000 + k, f"src/a{k}.js", HAND * (3 + k % 4) + f"# {k}\n", None) for k in range(29)]
    edge = (2_000, "src/e.js", ("x" * 60 + " " + "y" * 59 + "\n") * 20 + "z" * 255 + "\n", None)
    told = spark.createDataFrame([], "commit_sha string, subject string, n_files_added int")
    got = set()
    for more in ([], [own[0]], [(3_000, "src/n.js", HAND, None)]):
        files = spark.createDataFrame(wide + own[:28] + [edge] + more, "file_id bigint, rel string, text string, first_commit string")
        got.add(origins(files, told).where("file_id = 2000").first()["minified"])
    assert len(got) == 1


@pytest.mark.parametrize("licence", ["# A licence line.\n" * 40, "// " + "x" * 9_000 + "\n", "/*\n" + "  A licence line.\n\n" * 200 + "*/\n\n", "/-\n" + "A licence line.\n" * 30 + "-/\n", '"""\n' + "A licence line.\n" * 30 + '"""\n'])
def test_statements_behind_a_long_licence(licence):
    assert statements(licence + "// Code generated by toolgen.\n" + HAND) == (True, False)
    assert statements(licence + "# Taken verbatim from the foo distribution.\n" + HAND) == (False, True)
    assert statements(licence + HAND * 3 + "# Code generated by toolgen.\n") == (False, False)
    assert statements(licence + HAND) == (False, False)


def test_statements_inside_comments():
    notice = "Code generated by toolgen.\n"
    assert statements("/*\n" + "A licence line.\n" * 30 + notice + "*/\n")[0]
    assert not statements('"""Rows.\n\nThey are ' + notice + '"""\n' + HAND)[0]
    assert not statements("x = 1\n" * 20 + "# " + notice)[0] and statements("package x\n# " + notice)[0]


def test_layout_of_odd_texts():
    assert layout("") == (0, 0, 0, 0, 0, 0, 0) and layout(" \r\n ")[1] == 0
    assert layout("ab\r\ncd\rxyz\n")[1:3] == (3, 7 / 3)


NOTE = "Thanks to Marta Lindqvist for the fix.\nReported by J. Okafor <okafor.j@mail.example>.\nIf it stalls, call Sören B. Lindqvist on +44 20 7946 0018.\nOur visitor (passport no. QX-0017206) stays at 12 Larkspur Way, Larkhaven.\nThe Brellovan lemma gives a bound. Offsets +1 (300) 2048-1385 and +44 are relative. Clone git@forge.example:a/b.git\nrunner@node18:~$ python x.py --seed 5341\nAnschrift für den Versand: Saltmarshweg 287a, 00252 Velmouth\nContact: ana.okafor AT lab DOT example / 0491 570 157\nOkafor, Ana asked whether this is needed. The payroll form lists SSN 666-57-9641 for ANA OKAFOR.\n12 Window Lane widths were off by one window here.\n"
FACTS = [("person_name", "Marta Lindqvist"), ("person_name", "J. Okafor"), ("email", "okafor.j@mail.example"), ("person_name", "Sören B. Lindqvist"), ("phone", "+44 20 7946 0018"), ("id_number", "QX-0017206"), ("street_address", "12 Larkspur Way, Larkhaven"), ("street_address", "Saltmarshweg 287a, 00252 Velmouth"), ("email", "ana.okafor AT lab DOT example"), ("phone", "0491 570 157"), ("person_name", "Okafor, Ana"), ("id_number", "666-57-9641"), ("person_name", "ANA OKAFOR")]


def test_personal_data_is_found_and_masked(spark):
    filler = "A window must keep its order when the window grows. The Brellovan lemma holds.\n"
    rows = [(i, (filler + NOTE) if i % 3 else filler + "The Quorish lemma fails.\n") for i in range(60)]
    rows += [(900, None), (901, ""), (902, "no " * 200_000), (903, "A" * 100_000 + "@" + "1" * 100_000), (None, NOTE), (1, filler + NOTE)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kind", F.lit("x"))
    model = personal_info.fit(df, "doc_id", "text")
    text = filler + NOTE
    got = [(s.kind, text[s.start : s.end]) for s in model.spans(text)]
    assert got == FACTS
    found = personal_info.find(df, "doc_id", model=model)
    assert found.where("doc_id = 1").count() == 2 * len(FACTS) and found.where("doc_id >= 900").count() == 0
    assert {(r["kind"], r["start_char"]) for r in found.where("doc_id = 2").collect()} == {(k, text.index(v)) for k, v in FACTS}
    masks = {r["doc_id"]: r["masked"] for r in personal_info.mask(df, "doc_id", model=model).collect() if r["doc_id"] is not None}
    assert masks[900] is None and masks[901] == "" and "Marta" not in masks[1] and masks[1].count("[PERSON_NAME]") == 5 and "The Brellovan lemma" in masks[1]


def test_personal_data_in_other_wording(spark):
    rows, truth = planted.documents(1500, 7)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {(r["doc_id"], r["kind"], r["start_char"]) for r in personal_info.find(df, "doc_id").collect()}
    for kind, (n, recall, precision) in planted.score(got, truth).items():
        assert n > 100 and precision >= 0.97 and recall >= (0.7 if "not listed" in kind else 0.97), (kind, recall, precision)


def test_word_lists_have_no_limit_and_short_names(spark):
    rows = [(i, f"Thanks to Anna {'Kim' if i % 2 else 'Lee'} and Paul Nam{i // 4:05d}a for it.".replace("0", "o").replace("1", "i")) for i in range(400)]
    g = personal_info.gazetteers(spark.createDataFrame(rows, "key bigint, text string"))
    assert g.is_surname("Kim") and g.is_surname("LEE") and not g.is_surname("Thanks") and "thanks" not in g.ordinary and "for" in g.ordinary and "kim" in g.bare
    none = personal_info.Gazetteers(None)
    assert "for" not in none.ordinary and not none.is_surname("Kim")


def test_overlapping_spans_are_settled_by_score():
    rnd = random.Random(6)
    spans = [personal_info.Span("phone", a, a + rnd.randrange(1, 12), ()) for a in (rnd.randrange(500) for _ in range(200))]
    scores = [rnd.uniform(-1, 3) for _ in spans]
    want = []
    for _, s in sorted(((c, s) for c, s in zip(scores, spans) if c > 0), key=lambda x: (-x[0], x[1].start)):
        if all(s.end <= o.start or s.start >= o.end for o in want):
            want.append(s)
    assert personal_info.settled(spans, scores) == sorted(want, key=lambda s: s.start)


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert personal_info.find(df, "doc_id").count() == 0


def test_expectation_maximisation_recovers_reliabilities():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < acc, np.where(truth, 1, -1), np.where(truth, -1, 1)) for acc in (0.95, 0.9, 0.7)], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    likely = personal_info.reliabilities({tuple(map(int, p)): int(n) for p, n in zip(patterns, counts)})
    guess = np.array([likely[tuple(map(int, v))] > 0.5 for v in votes])
    assert (guess == truth).mean() > 0.95
