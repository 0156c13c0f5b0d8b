"""Typed records and byte spans of Python and Lean sources; kernels and their table functions.

A record is (kind, value). Spans cover every byte of a text once with the
classes word, literal, symbol, comment, layout. Texts that don't lex give a
null result with the reason.
"""

from __future__ import annotations

import ast
import hashlib
import io
import json
import keyword
import re
import tokenize
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LexError(ValueError):
    """A text that doesn't lex."""


_PY_KINDS = {getattr(tokenize, n): n for n in ("NEWLINE", "INDENT", "DEDENT", "NAME", "OP", "NUMBER", "STRING", "FSTRING_START", "FSTRING_MIDDLE", "FSTRING_END") if hasattr(tokenize, n)}
_PY_SKIP = {tokenize.COMMENT, tokenize.NL, tokenize.ENCODING, tokenize.ENDMARKER}
_EMPTY_VALUE = {"NEWLINE", "DEDENT"}


def _checked(text: str) -> str:
    if not text:
        raise LexError("empty text")
    if "\r" in text:
        raise LexError("carriage return")
    return text


def _py_tokens(text: str) -> list[tokenize.TokenInfo]:
    try:
        return list(tokenize.generate_tokens(io.StringIO(_checked(text)).readline))
    except (tokenize.TokenError, SyntaxError, ValueError) as err:
        raise LexError(str(err)) from err


def python_records(text: str) -> list[tuple[str, str]]:
    """Tokens without comments and blank lines; line ends and indentation stay."""
    out = []
    for t in _py_tokens(text):
        if t.type in _PY_SKIP:
            continue
        kind = _PY_KINDS.get(t.type)
        if kind is None:
            raise LexError(f"unexpected token {t.string!r}")
        out.append((kind, "" if kind in _EMPTY_VALUE else t.string))
    if not out:
        raise LexError("no tokens")
    return out


# Letters of Lean identifiers beyond ASCII.
_LETTER = "α-κμ-ωΑ-ΟΡΤ-Ωϊ-ϻἀ-῾℀-⅏𝒜-𝖟À-ÖØ-öø-ÿĀ-ſ"
_SUB = "₀-₉ₐ-ₜᵢ-ᵪⱼ"
_ID = rf"[A-Za-z_{_LETTER}][A-Za-z0-9_'!?{_LETTER}{_SUB}]*"
_CHAR = r"'(?:\\(?:[\\\"'rnt]|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4})|[^\\'\n])'"
_NUM = r"0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?"
_LEAN = re.compile(
    rf"(?P<ws>[ \t\n]+)|(?P<line>--[^\n]*\n?)|(?P<block>/-)|(?P<quoted>«[^»]*»)|(?P<raw>r\#*\")|(?P<interp>[A-Za-z_]\w*!\")|(?P<id>{_ID})|(?P<num>{_NUM})|(?P<str>\")|(?P<primes>''+)|(?P<char>{_CHAR})|(?P<op>.)",
    re.S,
)
_STRING_STEP = re.compile(r"[^\\\"{]+|\\.|[\"{]", re.S)
_COMMENT_STEP = re.compile(r"/-|-/")


def _block_end(text: str, at: int) -> int:
    depth = 0
    for m in _COMMENT_STEP.finditer(text, at):
        depth += 1 if m.group() == "/-" else -1
        if not depth:
            return m.end()
    raise LexError("unterminated block comment")


def _string_end(text: str, at: int, interpolated: bool = False) -> int:
    """End of a string whose content begins at ``at``; terms in braces are skipped with what they nest."""
    while m := _STRING_STEP.match(text, at):
        at = m.end()
        if m.group() == '"':
            return at
        if m.group() == "{" and interpolated:
            at = _term_end(text, at)
    raise LexError("unterminated string")


def _term_end(text: str, at: int) -> int:
    depth = 1
    while depth:
        m = _LEAN.match(text, at)
        if not m:
            raise LexError("unterminated interpolation")
        at = _token_end(text, m)
        depth += {"{": 1, "}": -1}.get(m.group(), 0) if m.lastgroup == "op" else 0
    return at


def _token_end(text: str, m: re.Match) -> int:
    kind = m.lastgroup
    if kind == "block":
        return _block_end(text, m.start())
    if kind == "raw":
        close = '"' + "#" * (len(m.group()) - 2)
        end = text.find(close, m.end())
        if end < 0:
            raise LexError("unterminated raw string")
        return end + len(close)
    if kind in ("str", "interp"):
        return _string_end(text, m.end(), kind == "interp")
    return m.end()


_LEAN_KINDS = {"quoted": "IDENT", "id": "IDENT", "num": "NUM", "raw": "STR", "str": "STR", "interp": "STR", "char": "CHAR", "op": "OP", "primes": "OP"}


def _lean_tokens(text: str) -> Iterator[tuple[str, int, int]]:
    at, n = 0, len(_checked(text))
    while at < n:
        m = _LEAN.match(text, at)
        end = _token_end(text, m)
        if m.lastgroup == "op" and m.group() in "«»":
            raise LexError("unterminated quoted identifier")
        if m.lastgroup == "op" and m.group() == "'" and (at == 0 or text[at - 1].isspace()):
            raise LexError("malformed character")
        yield m.lastgroup, at, end
        at = end


def lean_records(text: str) -> list[tuple[str, str]]:
    """Tokens without comments; a LAYOUT record with the indentation where a token starts on a later line than the one before."""
    starts = [0, *(m.end() for m in re.finditer("\n", text or ""))]
    out: list[tuple[str, str]] = []
    last = None
    for kind, a, b in _lean_tokens(text):
        if kind not in _LEAN_KINDS:
            continue
        for k in range(a, b) if kind == "primes" else (a,):
            line = bisect_right(starts, k) - 1
            if last is not None and line > last:
                head = text[starts[line] :]
                out.append(("LAYOUT", head[: len(head) - len(head.lstrip(" \t"))]))
            last = line
            out.append((_LEAN_KINDS[kind], "'" if kind == "primes" else text[a:b]))
    if not out:
        raise LexError("no tokens")
    return out


def lexical(records: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [r for r in records if r[0] not in ("NEWLINE", "INDENT", "DEDENT", "LAYOUT")]


def renamed(records: list[tuple[str, str]], keywords: frozenset[str] = frozenset()) -> list[tuple[str, str | int]]:
    """Identifiers that are no keywords replaced by ("IDRANK", rank of their first appearance)."""
    seen: dict[str, int] = {}
    return [("IDRANK", seen.setdefault(v, len(seen))) if k in ("NAME", "IDENT") and v not in keywords else (k, v) for k, v in records]


# Words of Lean that are no identifiers.
LEAN_KEYWORDS = frozenset(
    """abbrev axiom by calc class def deriving do else end example extends for from fun have if import in inductive infix infixl infixr instance lemma let macro match
    mutual namespace nomatch notation opaque open postfix prefix private protected return section set_option show structure syntax then theorem universe variable where with""".split()
)
#: Lexical records in a gram.
GRAM = 5


def _json_sha256(value) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest()


def fingerprint(text: str, lang: str) -> dict:
    """Numbers of records, hashes of the records as they are and with renamed identifiers, 64-bit hashes of the distinct grams.

    Hashes are the sha256 of the compact JSON of [[kind, value], ...]; grams
    are runs of GRAM lexical records, layout left out.
    """
    rows = python_records(text) if lang == "python" else lean_records(text)
    lex = [json.dumps(r, ensure_ascii=False) for r in lexical(rows)]
    runs = {"\0".join(lex[i : i + GRAM]) for i in range(len(lex) - GRAM + 1)}
    grams = [int.from_bytes(hashlib.blake2b(r.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) for r in runs]
    keywords = frozenset(keyword.kwlist) if lang == "python" else LEAN_KEYWORDS
    return {"n_records": len(rows), "n_lexical": len(lex), "verbatim": _json_sha256(rows), "normalized": _json_sha256(renamed(rows, keywords)), "grams": sorted(grams)}


_LEAN_CLASS = {"IDENT": "word", "NUM": "literal", "STR": "literal", "CHAR": "literal", "OP": "symbol"}
_PY_CLASS = {"NAME": "word", "NUMBER": "literal", "STRING": "literal", "FSTRING_START": "literal", "FSTRING_MIDDLE": "literal", "FSTRING_END": "literal", "OP": "symbol"}


def byte_prefix(text: str) -> list[int]:
    """Bytes before each character, one more entry than characters."""
    out, total = [0], 0
    for ch in text:
        total += len(ch.encode())
        out.append(total)
    return out


def source_spans(text: str, lang: str) -> list[tuple[str, int, int]]:
    """(class, start, end) in bytes; neighbours of one class are joined, the whole text is covered."""
    chars: list[tuple[str, int, int]] = []
    if lang == "lean":
        for kind, a, b in _lean_tokens(text):
            chars.append(("layout" if kind == "ws" else "comment" if kind in ("line", "block") else _LEAN_CLASS[_LEAN_KINDS[kind]], a, b))
    else:
        starts = [0, *(m.end() for m in re.finditer("\n", text))]
        at = 0
        for t in _py_tokens(text):
            name = "comment" if t.type == tokenize.COMMENT else _PY_CLASS.get(_PY_KINDS.get(t.type, ""))
            if name is None:
                continue
            a, b = (min(starts[min(line, len(starts)) - 1] + col, len(text)) for line, col in (t.start, t.end))
            if a > at:
                chars.append(("layout", at, a))
            if b > max(a, at):
                chars.append((name, max(a, at), b))
            at = max(at, b)
        if at < len(text):
            chars.append(("layout", at, len(text)))
    prefix = byte_prefix(text)
    out: list[tuple[str, int, int]] = []
    for name, a, b in chars:
        if out and out[-1][0] == name and out[-1][2] == prefix[a]:
            out[-1] = (name, out[-1][1], prefix[b])
        else:
            out.append((name, prefix[a], prefix[b]))
    return out


def _line_bytes(data: bytes) -> list[int]:
    return [0, *(i + 1 for i, b in enumerate(data) if b == 10)]


def python_targets(text: str) -> list[dict]:
    """Top-level functions and classes with byte spans, header end, docstring bytes and the names they use."""
    data = _checked(text).encode()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as err:
        raise LexError(str(err)) from err
    lines = _line_bytes(data)
    at = lambda line, col: lines[line - 1] + col
    out = []
    for node in tree.body:
        if not isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            continue
        first = min([node, *node.decorator_list], key=lambda x: (x.lineno, x.col_offset))
        start = at(first.lineno, first.col_offset)
        if node.decorator_list:
            start = data.rindex(b"@", 0, start + 1)
        end = at(node.end_lineno, node.end_col_offset)
        body = node.body[0]
        doc = isinstance(body, ast.Expr) and isinstance(body.value, ast.Constant) and isinstance(body.value.value, str)
        bound = {a.arg for f in ast.walk(node) if isinstance(f, ast.arguments) for a in [*f.posonlyargs, *f.args, *f.kwonlyargs, *filter(None, (f.vararg, f.kwarg))]}
        bound |= {n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}
        used = sorted({n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load)} - bound)
        out.append(
            {
                "name": node.name,
                "kind": "class" if isinstance(node, ast.ClassDef) else "function",
                "start_byte": start,
                "end_byte": end,
                "body_byte": at(body.lineno, body.col_offset),
                "doc_bytes": at(body.end_lineno, body.end_col_offset) - at(body.lineno, body.col_offset) if doc else 0,
                "refs": used,
            }
        )
    return out


def python_imports(text: str, module: str, is_init: bool = False) -> dict[str, str]:
    """Local name to absolute dotted name; relative imports that leave the root are left out."""
    from tessella.functions.scalars import resolve_relative

    out = {}
    for node in ast.parse(text).body:
        if isinstance(node, ast.Import):
            for a in node.names:
                out[a.asname or a.name.split(".")[0]] = a.name if a.asname else a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            base = node.module if not node.level else resolve_relative(module, is_init, node.level, node.module)
            for a in node.names if base else ():
                if a.name != "*":
                    out[a.asname or a.name] = f"{base}.{a.name}"
    return out


def _apply(kernel: Callable, fields: pa.Schema) -> Callable:
    """Rows of a kernel for each (id, text, lang); a text that doesn't lex gives one row with the reason."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for key, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    out += [{"id": key, "error": None} | row for row in kernel(text or "", lang)]
                except LexError as err:
                    out.append({"id": key, "error": str(err)[:120]})
            yield from pa.Table.from_pylist(out, schema=fields).to_batches() or [pa.RecordBatch.from_pylist([], schema=fields)]

    return run


def _table(df: DataFrame, key: str, text: str, lang: str, kernel: Callable, spec: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    fields = pa.schema([("id", pa.int64()), ("error", pa.string()), *[(n, t) for n, (_, t) in spec.items()]])
    ddl = "id bigint, error string, " + ", ".join(f"`{n}` {s}" for n, (s, _) in spec.items())
    # line ends of all kinds count as line feeds
    lf = F.regexp_replace(text, "\r\n?", "\n")
    return df.select(F.col(key).cast("bigint").alias("id"), lf.alias("text"), F.col(lang).alias("lang")).mapInArrow(_apply(kernel, fields), ddl).withColumnRenamed("id", key)


def typed_records(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """One row per record: key, pos, kind, value (Python for 'python', Lean for the rest)."""
    kernel = lambda t, g: ({"pos": i, "kind": k, "value": v} for i, (k, v) in enumerate(python_records(t) if g == "python" else lean_records(t)))
    return _table(df, key, text, lang, kernel, {"pos": ("int", pa.int32()), "kind": ("string", pa.string()), "value": ("string", pa.string())})


def fingerprint_table(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """One row per text with its ``fingerprint``; a text that doesn't lex has the reason in ``error`` and nulls."""
    spec = {"n_records": ("int", pa.int32()), "n_lexical": ("int", pa.int32()), "verbatim": ("string", pa.string()), "normalized": ("string", pa.string()), "grams": ("array<bigint>", pa.list_(pa.int64()))}
    return _table(df, key, text, lang, lambda t, g: [fingerprint(t, g)], spec)


def span_table(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    kernel = lambda t, g: ({"cls": c, "start": a, "end": b} for c, a, b in source_spans(t, "lean" if g == "lean" else "python"))
    return _table(df, key, text, lang, kernel, {"cls": ("string", pa.string()), "start": ("bigint", pa.int64()), "end": ("bigint", pa.int64())})


def target_table(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    spec = {n: ("bigint", pa.int64()) for n in ("start_byte", "end_byte", "body_byte", "doc_bytes")}
    spec = {"name": ("string", pa.string()), "kind": ("string", pa.string())} | spec | {"refs": ("array<string>", pa.list_(pa.string()))}
    return _table(df, key, text, lang, lambda t, g: python_targets(t) if t.strip() else [], spec)
