import gzip
import io
import json
import tarfile
import tokenize

import pytest

from tessella.functions import generated, lean_source, lexers, scalars
from tessella.sources import files
from tessella.streaming.ingest import ingest


def dump(path, rows):
    with gzip.open(path, "wt") as f:
        f.write("win,doc,ctxb,blen,tok,nll,grp\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))


def test_corpus_scan(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "long.py").write_text("x" * 100)
    (tmp_path / "a" / "short.py").write_text("x")
    (tmp_path / "bad.py").write_bytes(b"\xff" * 100)
    (tmp_path / ".git" / "c.py").write_text("y" * 100)
    (tmp_path / "other.txt").write_text("y" * 100)
    got = files.corpus_files(spark, str(tmp_path), [".py"]).collect()
    assert [(r["rel"], r["bytes"], r["text"][-1]) for r in got] == [("a/long.py", 101, "\n")]


def test_dumps_are_reconciled(spark, tmp_path):
    dump(tmp_path / "m__c__full.csv.gz", [(0, 1, 0, 3, 5, 0.5, 0), (0, 1, 3, 2, 6, 0.25, 1)])
    d = files.token_dumps(spark, str(tmp_path / "*.csv.gz"))
    meta = spark.createDataFrame([("m__c__full", 2, 5), ("gone", 1, 1)], "cell_name string, n_scored bigint, bytes_scored bigint")
    assert {r["cell_name"]: r["ok"] for r in files.reconciled(d, meta).collect()} == {"m__c__full": True, "gone": False}


def test_ingest_takes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    dump(src / "a.csv.gz", [(0, 1, 0, 3, 5, 0.5, 0), (0, 1, 0, 3, 5, "NaN", 0)])
    for k in range(2):
        ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 1 + k * 0
    dump(src / "b.csv.gz", [(0, 1, 0, 3, 5, 0.5, 0)])
    ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_json_objects_are_strict(spark, tmp_path):
    for name, text in (("ok", '{"a": 1}'), ("twice", '{"a": 1, "a": 2}'), ("nan", '{"a": NaN}'), ("list", "[1]")):
        (tmp_path / f"{name}.json").write_text(text)
    got = {r["path"].rsplit("/", 1)[1]: r["error"] for r in files.json_objects(spark, str(tmp_path)).collect()}
    assert got["ok.json"] is None and all(got[f"{k}.json"] for k in ("twice", "nan", "list"))


def test_reference_index(spark):
    key = json.dumps({"c": {"m": "M", "n": "f"}})
    text = json.dumps({"version": 5, "module": "A", "references": {key: {"usages": [["1", "2", "3", "4", "g"], ["5", "6", "7", "8"]]}, json.dumps({"f": {"m": "M", "i": "x"}}): {"usages": []}}})
    got = files.reference_index(spark.createDataFrame([(text,)], "text string")).collect()
    assert {(r["name"], r["defined_in"], r["parent"], r["line"]) for r in got} == {("f", "M", "g", 1), ("f", "M", None, 5)}


def test_writing_once_and_what_is_pending(spark, tmp_path):
    d = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    files.write_once(d.where("k = 1"), str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_once(d, str(tmp_path / "t"))
    assert {r["k"] for r in files.pending(d, spark.read.parquet(str(tmp_path / "t")), ["k"]).collect()} == {2, None}


def test_manifest(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"doc_id": 1, "rel": "a", "start": 0, "end": 5, "date": null, "provenance_flag": false}\n')
    assert files.manifest(spark, str(tmp_path / "m.jsonl")).first()["end"] == 5


def test_python_comments_and_blank_lines_do_not_count():
    a, b = "def f(x):\n    return x\n", "# hi\n\ndef f(x):  # there\n\n    return x\n"
    assert lexers.python_records(a) == lexers.python_records(b)
    assert lexers.renamed(lexers.python_records(a)) == lexers.renamed(lexers.python_records(a.replace("x", "y")))
    with pytest.raises(lexers.LexError):
        lexers.python_records("def f(:\n  '''")
    with pytest.raises(lexers.LexError):
        lexers.python_records("a\r\n")


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("a /- x /- y -/ z -/ b", ["a", "b"]),
        ("def «odd name» := 'c'", ["def", "«odd name»", ":", "=", "'c'"]),
        ('x "a -- b" 0xFF 1.5e3 r#"q"w"#', ["x", '"a -- b"', "0xFF", "1.5e3", 'r#"q"w"#']),
        ('s!"a {f "}" /- } -/} b" c', ['s!"a {f "}" /- } -/} b"', "c"]),
        ("h₁ x' α ]'", ["h₁", "x'", "α", "]", "'"]),
    ],
)
def test_lean_tokens(text, values):
    assert [v for _, v in lexers.lexical(lexers.lean_records(text))] == values


@pytest.mark.parametrize("text", ["/- open", '"open', "«open", "x 'ab", "", 's!"{'])
def test_broken_lean_is_refused(text):
    with pytest.raises(lexers.LexError):
        lexers.lean_records(text)


def test_lean_layout_follows_the_start_of_tokens():
    assert lexers.lean_records("a\n  b") == [("IDENT", "a"), ("LAYOUT", "  "), ("IDENT", "b")]


@pytest.mark.parametrize(("lang", "text"), [("lean", "theorem t : 1 = 1 := by -- é\n  rfl"), ("python", "x = f'{a}' # é\n\ndef g():\n    return 'ü'\n")])
def test_spans_cover_the_text(lang, text):
    s = lexers.source_spans(text, lang)
    assert s[0][1] == 0 and s[-1][2] == len(text.encode()) and all(a[2] == b[1] for a, b in zip(s, s[1:]))


def test_python_targets():
    text = "import os\n\n@dec(1)\ndef f(a, b=os):\n    '''doc'''\n    return a + g\n\nclass C:\n    pass\n"
    f, c = lexers.python_targets(text)
    assert text.encode()[f["start_byte"] : f["end_byte"]].decode().startswith("@dec") and f["doc_bytes"] == 9
    assert f["refs"] == ["dec", "g", "os"] and c["kind"] == "class"
    assert lexers.python_imports("from . import x\nimport a.b as c\n", "p.q") == {"x": "p.x", "c": "a.b"}
    assert tokenize  # the lexer follows the tokenizer of this Python


def test_scalars(spark):
    assert scalars.utf16_to_byte("a\n😀b", 1, 2) == 6
    with pytest.raises(ValueError):
        scalars.utf16_to_byte("😀", 0, 1)
    assert scalars.utf8_cut("é€".encode(), 4) == "é".encode() and scalars.utf8_suffix("é€".encode(), 4) == "€".encode()
    assert scalars.resolve_relative("a.b.c", False, 2, "d") == "a.d" and scalars.resolve_relative("a", False, 2, None) is None
    assert scalars.key_of_identity("lean", '[ "M", "d" ]') == '["M","d"]' and scalars.key_of_identity("python", '["M", "d", true]') is None
    d = spark.createDataFrame([("a/../b", "x"), ("a/b", "x\n\n\n"), (None, "x\r\n")], "p string, t string")
    got = d.select(scalars.is_relative_path("p").alias("ok"), scalars.one_line_feed("t").alias("t")).collect()
    assert [tuple(r) for r in got] == [(False, "x\n"), (True, "x\n"), (False, "x\r\n")]
    h = d.select(scalars.masked_id("fam", b"s", "d", "t").alias("h")).collect()
    assert all(len(r["h"]) == 20 for r in h)


def test_lean_declarations():
    text = """import A
namespace Foo
section
/-- doc -/
@[simp, foo (a := b)]
private theorem bar (h : (x := 1)) : "a | := " = 1 := by
  simp
end
def baz : Nat
  | 0 => 1
end Foo
instance : Inhabited Nat where
  default := 0
"""
    got = lean_source.declarations(text)
    data = text.encode()
    assert [(d["kind"], d["name"], d["scope"]) for d in got] == [("theorem", "bar", "Foo"), ("def", "baz", "Foo"), ("instance", None, "")]
    assert data[got[0]["start_byte"] :].startswith(b"@[simp") and data[got[0]["header_byte"] :].startswith(b":= by")
    assert data[got[1]["header_byte"] :].startswith(b"| 0") and data[got[2]["header_byte"] :].startswith(b"where")
    assert lean_source.declaration_kind("-- c\n@[simp] protected lemma x : 1 = 1") == "lemma" and lean_source.declaration_kind("1 + 1") is None
    mask = lean_source.code_mask('a -- b\n"c" d')
    assert "".join(c for c, m in zip('a -- b\n"c" d', mask) if m).split() == ["a", "d"]


def test_archives(spark, tmp_path):
    box = io.BytesIO()
    with tarfile.open(fileobj=box, mode="w") as tar:
        for name, data in (("b.tex", b"two"), ("a.tex", "\u00e9".encode("latin-1")), ("c.png", b"x")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    for name, data in (("tar", gzip.compress(box.getvalue())), ("pdf", b"%PDF-1"), ("plain", gzip.compress(b"one")), ("broken", b"\x1f\x8bxx"), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"]) for r in files.source_archives(spark, str(tmp_path)).collect()}
    assert got["tar"] == ("\u00e9\ntwo", None) and got["pdf"] == (None, "pdf") and got["plain"] == ("one", None) and got["broken"][0] is None and "empty" not in got


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("\n    return 1\n\nprint(2)\n", (None, "block", "\n    return 1\n\n")),
        (" return 1\nx = 2\n", (None, "line", " return 1\n")),
        ("\n  if a:\n    b()\n  c()\nd()", (None, "block", "\n  if a:\n    b()\n  c()\n")),
        ("", ("empty", None, None)),
        ("\nreturn 1\n", ("block-not-indented", None, None)),
        (" return 1", ("line-not-ended", None, None)),
        ("\n    x = (1\n", ("does-not-tokenize", None, None)),
        ("\n    x = = 1\ny\n", ("does-not-parse", None, None)),
        ("\r\n  pass\n", ("carriage-return", None, None)),
        ("# only a comment\n", ("block-not-indented", None, None)),
    ],
)
def test_first_suite(text, want):
    r = generated.first_suite("def f(a):", text, name="f")
    assert (r["reason"], r["form"], r["body"]) == want
    with pytest.raises(ValueError):
        generated.first_suite("class f:", text, name="f")


def test_type_trees():
    ok = ["forall", ["sort", ["succ", ["zero"]]], ["app", ["const", ["str", ["anonymous"], "f"], [["zero"], ["max", ["zero"], ["zero"]]]], ["bvar", 0]], "default"]
    assert generated.tree_nodes(json.dumps(ok)) == 14
    for bad in (["bvar", -1], ["bvar", True], ["app", ["bvar", 0]], ["lam", ["bvar", 0], ["bvar", 0], "odd"], {"a": 1}, ["const", ["anonymous"], ["zero"]], []):
        assert generated.tree_nodes(json.dumps(bad)) is None
    assert generated.tree_nodes(json.dumps(ok), 5) is None and generated.tree_nodes("no") is None


def test_completions_and_token_lists_give_their_faults(spark, tmp_path):
    texts = {"ok": "state\tdone\nn\t3\n", "twice": "a\t1\na\t2\n", "bad": "a 1\n", "none": "\n\n", "nothing": "", "crlf": "a\t1\r\nb\t\r\n"}
    for name, text in texts.items():
        (tmp_path / f"{name}.tsv").write_bytes(text.encode())
    got = {r["path"].rsplit("/", 1)[1][:-4]: (r["fields"], r["error"]) for r in files.completions(spark, f"file://{tmp_path}/*.tsv").collect()}
    assert got == {"ok": ({"state": "done", "n": "3"}, None), "twice": (None, "repeated-key"), "bad": (None, "malformed"), "none": (None, "empty"), "crlf": ({"a": "1", "b": ""}, None)}
    lists = {"ok": "abs\nby\nλ\n", "open": "a\nb", "dos": "a\r\nb\r\n", "gap": "a\n\nb\n", "dup": "a\na\n", "down": "b\na\n", "nothing": ""}
    for name, text in lists.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    got = {r["path"].rsplit("/", 1)[1][:-4]: (r["tokens"], r["error"]) for r in files.token_lists(spark, f"file://{tmp_path}/*.txt").collect()}
    assert got == {"ok": (["abs", "by", "λ"], None), "open": (None, "no-final-line-feed"), "dos": (None, "carriage-return"), "gap": (None, "empty-line"), "dup": (None, "repeated"), "down": (None, "unsorted")}


def test_artifacts_are_bound_by_schema_and_hash(spark, tmp_path):
    import hashlib

    text = {"a": '{"schema": "v1", "n": 1}', "b": '{"schema": "v2"}', "c": '{"schema": "v1", "schema": "v1"}', "d": '{"schema": "v1"}'}
    for name, t in text.items():
        (tmp_path / f"{name}.json").write_text(t)
    sha = {n: hashlib.sha256(t.encode()).hexdigest() for n, t in text.items()}
    wanted = spark.createDataFrame([("a.json", "v1", sha["a"]), ("b.json", "v1", sha["b"]), ("c.json", "v1", sha["c"]), ("d.json", "v1", sha["a"]), ("e.json", "v1", "x")], "name string, schema string, sha256 string")
    got = {r["name"]: r["state"] for r in files.bindings(files.json_objects(spark, f"file://{tmp_path}/*.json"), wanted).collect()}
    assert got == {"a.json": "bound", "b.json": "other-schema", "c.json": "malformed", "d.json": "other-hash", "e.json": "missing"}
    pairs = spark.createDataFrame([("s1", "1", "i1", "2"), ("s2", "1", "i1", "2"), ("s1", "9", "i1", "2"), ("s1", "1", "i1", "9")], "rel string, sha256 string, index_rel string, index_sha256 string")
    have = spark.createDataFrame([("s1", "1"), ("i1", "2")], "rel string, sha256 string")
    assert sorted(r["state"] for r in files.rehashed_pairs(pairs, have).collect()) == ["index-changed", "missing", "paired", "source-changed"]


def test_streams_are_written_in_order(spark, tmp_path):
    rows = [("a" if i % 3 else "b", f"f{i:04d}", f"line {i}\nmore" + ("\n" if i % 2 else "")) for i in range(200)] + [("a", "z", None)]
    df = spark.createDataFrame(rows, "s string, rel string, text string").repartition(5)
    files.write_streams(df, f"file://{tmp_path}/out", "s", ["rel"])
    for s in "ab":
        got = "".join(p.read_text() for p in sorted((tmp_path / "out" / f"stream={s}").glob("part-*")))
        assert got == "".join(t if t.endswith("\n") else t + "\n" for k, _, t in sorted(rows[:-1]) if k == s)
    files.write_reports(spark.createDataFrame([(1, [2, 3])], "n int, l array<int>"), f"file://{tmp_path}/rep")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/rep/csv").columns == ["n"] and spark.read.json(f"file://{tmp_path}/rep/json").first()["l"] == [2, 3]
