"""Checks of generated material: the first complete suite of a continuation, and trees of a fixed grammar."""

from __future__ import annotations

import ast
import io
import json
import tokenize
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NODES = {"function": (ast.FunctionDef, ast.AsyncFunctionDef), "class": (ast.ClassDef,)}


class _Stop(Exception):
    """Why there is no suite."""


def _suite(header: str, generated: str) -> tuple[str, int]:
    """Form of the suite and the character of the continuation behind it; tokens are drawn only as far as needed."""
    document = header + generated
    lines = [0]
    for i, ch in enumerate(document):
        if ch == "\n":
            lines.append(i + 1)
    place = lambda pos: min(lines[min(pos[0], len(lines)) - 1] + pos[1], len(document))
    edge, form, depth = len(header), None, 0
    for t in tokenize.generate_tokens(io.StringIO(document).readline):
        a, b = place(t.start), place(t.end)
        if a < edge:
            if b > edge:
                raise _Stop("token-crosses-the-edge")
            continue
        if t.type in (tokenize.COMMENT, tokenize.NL):
            continue
        if form is None:
            if t.type in (tokenize.ENDMARKER, tokenize.INDENT, tokenize.DEDENT):
                raise _Stop("no-suite")
            form = "block" if t.type == tokenize.NEWLINE else "line"
            if form == "block":
                continue
        if form == "line":
            if t.type == tokenize.NEWLINE and t.string:
                return form, b - edge
            if t.type in (tokenize.NEWLINE, tokenize.ENDMARKER):
                raise _Stop("line-not-ended")
        elif t.type == tokenize.INDENT:
            depth += 1
        elif not depth:
            raise _Stop("block-not-indented")
        elif t.type == tokenize.DEDENT:
            depth -= 1
            if not depth:
                return form, a - edge
    raise _Stop("suite-not-ended")


def first_suite(header: str, generated: str, kind: str = "function", name: str | None = None) -> dict:
    """The first complete suite that a continuation gives a header ending in its colon.

    ``reason`` is null if there is one; then ``form`` (line or block), ``body``
    and ``discarded`` (characters behind it). A header that isn't one of the
    kind and name is an error, not a reason.
    """
    node = ast.parse(header + " pass").body
    if "\r" in header or not header.endswith(":") or len(node) != 1 or not isinstance(node[0], _NODES[kind]) or (name and node[0].name != name):
        raise ValueError("not a header of this kind")
    out = {"reason": None, "form": None, "body": None, "discarded": None}
    if not generated:
        return out | {"reason": "empty"}
    if "\r" in generated:
        return out | {"reason": "carriage-return"}
    try:
        form, end = _suite(header, generated)
    except _Stop as why:
        return out | {"reason": str(why)}
    except (tokenize.TokenError, SyntaxError, ValueError):
        return out | {"reason": "does-not-tokenize"}
    if end <= 0:
        return out | {"reason": "empty-body"}
    try:
        tree = ast.parse(header + generated[:end]).body
    except (SyntaxError, ValueError, RecursionError):
        return out | {"reason": "does-not-parse"}
    if len(tree) != 1 or not isinstance(tree[0], _NODES[kind]):
        return out | {"reason": "more-than-a-body"}
    return out | {"form": form, "body": generated[:end], "discarded": len(generated) - end}


def suite_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """Each definition taken apart at its first ':' at the end of a line: what follows is treated as generated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                cut = (t or "").find(":\n") + 1
                try:
                    r = first_suite(t[:cut], t[cut:] + "\nprint(0)\n", "class" if t.startswith("class") else "function") if cut else None
                except (SyntaxError, ValueError):
                    r = None
                rows.append((k, r["reason"] if r else "no-header", r["form"] if r else None, len(r["body"]) if r and r["body"] else None, r["discarded"] if r else None))
            c = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), *[pa.array(x, pa.string()) for x in c[1:3]], *[pa.array(x, pa.int64()) for x in c[3:]]], names=["id", "reason", "form", "body_chars", "discarded"])

    lf = F.regexp_replace(text, "\r\n?", "\n")
    return df.select(F.col(key).cast("bigint").alias("id"), lf.alias("t")).mapInArrow(run, "id bigint, reason string, form string, body_chars bigint, discarded bigint").withColumnRenamed("id", key)


# The grammar of type trees. Each tag has the kinds of its fields.
TREE = {
    "name": {"anonymous": (), "str": ("name", "text"), "num": ("name", "count")},
    "level": {"zero": (), "succ": ("level",), "max": ("level", "level"), "imax": ("level", "level"), "param": ("name",)},
    "expr": {
        "bvar": ("count",),
        "sort": ("level",),
        "const": ("name", "levels"),
        "app": ("expr", "expr"),
        "lam": ("expr", "expr", "binder"),
        "forall": ("expr", "expr", "binder"),
        "let": ("expr", "expr", "expr", "flag"),
        "lit-nat": ("count",),
        "lit-string": ("text",),
        "proj": ("name", "count", "expr"),
    },
}
BINDERS = frozenset(("default", "implicit", "strict-implicit", "instance-implicit"))
MOST_NODES = 1_000_000
_LEAF = {"text": lambda v: isinstance(v, str), "count": lambda v: type(v) is int and v >= 0, "flag": lambda v: type(v) is bool, "binder": lambda v: isinstance(v, str) and v in BINDERS}


def tree_nodes(text: str, most: int = MOST_NODES) -> int | None:
    """Number of nodes of a type tree in JSON, null if it breaks the grammar or has more than ``most``."""
    try:
        todo, n = [("expr", json.loads(text))], 0
    except (TypeError, ValueError, RecursionError):
        return None
    while todo:
        kind, value = todo.pop()
        if kind in _LEAF:
            if not _LEAF[kind](value):
                return None
            continue
        n += 1
        if n > most or not isinstance(value, list):
            return None
        if kind == "levels":
            todo += [("level", v) for v in value]
            continue
        fields = TREE[kind].get(value[0]) if value and isinstance(value[0], str) else None
        if fields is None or len(value) != len(fields) + 1:
            return None
        todo += zip(fields, value[1:])
    return n
