"""Declarations of Lean files from their tokens: kinds, headers, scopes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.functions.lexers import LexError, _checked, _lean_tokens, _table, byte_prefix

# Words that begin a declaration, words that may stand before them, brackets.
KINDS = frozenset("theorem lemma def abbrev instance structure class inductive axiom opaque example".split())
MODIFIERS = frozenset("private protected noncomputable unsafe partial nonrec scoped local public meta".split())
COMMANDS = frozenset("namespace section end mutual open variable universe set_option import attribute macro notation syntax elab".split())
OPEN, CLOSE = frozenset("([{⟨⦃"), frozenset(")]}⟩⦄")


def code_mask(text: str) -> list[bool]:
    """Per character whether it is code: neither comment nor string nor character literal."""
    out = [True] * len(text)
    for kind, a, b in _lean_tokens(text):
        if kind in ("line", "block", "raw", "str", "interp", "char"):
            out[a:b] = [False] * (b - a)
    return out


def _words(text: str) -> list[tuple[str, int, int]]:
    """Tokens that are no white space or comment, with := as one."""
    out: list[tuple[str, int, int]] = []
    for kind, a, b in _lean_tokens(text):
        if kind in ("ws", "line", "block"):
            continue
        word = text[a:b]
        if word == "=" and out and out[-1][0] == ":" and out[-1][2] == a:
            out[-1] = (":=", out[-1][1], b)
        else:
            out.append((word, a, b))
    return out


def header_end(words: list[tuple[str, int, int]]) -> int | None:
    """Where the body begins: the first :=, | or where outside of brackets; null if there is none."""
    depth = 0
    for word, a, _ in words:
        depth += (word in OPEN) - (word in CLOSE)
        if not depth and word in (":=", "|", "where"):
            return a
    return None


def _skip_attribute(words: list[tuple[str, int, int]], i: int) -> int:
    depth = 0
    for j in range(i + 1, len(words)):
        depth += (words[j][0] in OPEN) - (words[j][0] in CLOSE)
        if not depth:
            return j + 1
    raise LexError("unclosed attribute")


def declaration_kind(text: str) -> str | None:
    """The first command word behind comments, attributes and modifiers."""
    words, i = _words(_checked(text)), 0
    while i < len(words):
        if words[i][0] == "@" and i + 1 < len(words) and words[i + 1][0] == "[":
            i = _skip_attribute(words, i)
        elif words[i][0] in MODIFIERS:
            i += 1
        else:
            return words[i][0] if words[i][0] in KINDS | COMMANDS else None
    return None


def declarations(text: str) -> list[dict]:
    """Declarations at the beginning of lines: kind, name, scope, bytes of start, header end and end.

    The scope is the path of open namespaces; sections count for closing
    only. A declaration starts at its attributes or modifiers and ends where
    the next command does.
    """
    words, prefix = _words(_checked(text)), byte_prefix(text)
    line_start = lambda a: a == 0 or text[a - 1] == "\n"
    stack: list[tuple[str, str]] = []
    found: list[dict] = []
    starts: list[int] = []
    i, begin = 0, None
    while i < len(words):
        word, a, _ = words[i]
        if not line_start(a) and begin is None:
            i += 1
            continue
        begin = a if begin is None else begin
        nxt = words[i + 1] if i + 1 < len(words) else ("", len(text), len(text))
        if word == "@" and nxt[0] == "[":
            i = _skip_attribute(words, i)
            continue
        if word in MODIFIERS:
            i += 1
            continue
        if word in KINDS | COMMANDS:
            starts.append(begin)
        if word in ("namespace", "section", "mutual"):
            same = "\n" not in text[a : nxt[1]] and nxt[0]
            stack.append((word, nxt[0] if same and word != "mutual" else ""))
        elif word == "end" and stack:
            stack.pop()
        elif word in KINDS:
            named = nxt[0] not in (":", ":=", "|", "where", "{", "(", "[", "")
            scope = ".".join(n for k, n in stack if k == "namespace")
            found.append({"kind": word, "name": nxt[0] if named else None, "scope": scope, "from": begin, "at": i})
        begin = None
        i += 1
    out = []
    for d in found:
        end = next((s for s in starts if s > d["from"]), len(text))
        inside = [w for w in words[d["at"] :] if w[1] < end]
        h = header_end(inside)
        out.append({"kind": d["kind"], "name": d["name"], "scope": d["scope"], "start_byte": prefix[d["from"]], "header_byte": prefix[h] if h is not None else None, "end_byte": prefix[end]})
    return out


def declaration_table(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    spec = {n: ("string", pa.string()) for n in ("kind", "name", "scope")} | {n: ("bigint", pa.int64()) for n in ("start_byte", "header_byte", "end_byte")}
    return _table(df, key, text, lang, lambda t, _: declarations(t) if t.strip() else [], spec)
