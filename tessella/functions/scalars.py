"""Scalar functions: encodings, hashes, positions, paths, renderings."""

from __future__ import annotations

import hashlib
import hmac
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_json(value) -> str:
    """Compact JSON, no escapes beyond those needed, no NaN."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def sorted_json_hash(value) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True, allow_nan=False).encode()).hexdigest()


def seeded_hash(label: str, scope: Column, *fields: Column) -> Column:
    """sha256 of the JSON array [label, scope, fields...]; string fields only."""
    return F.sha2(F.to_json(F.array(F.lit(label), scope, *fields)), 256)


def masked_id(prefix: str, salt: bytes, domain: str, *fields: str):
    """prefix- and the first 16 hex digits of an HMAC over domain:field:field, for a column of each field."""

    @F.pandas_udf("string")
    def run(*cols: pd.Series) -> pd.Series:
        text = pd.concat(cols, axis=1).astype(str).agg(":".join, axis=1)
        return text.map(lambda t: f"{prefix}-" + hmac.new(salt, f"{domain}:{t}".encode(), hashlib.sha256).hexdigest()[:16])

    return run(*[F.col(f) for f in fields])


def hmac_sign(salt: bytes, text: str) -> int:
    """1 or -1 by the parity of the HMAC."""
    return 1 if hmac.new(salt, text.encode(), hashlib.sha256).digest()[-1] % 2 == 0 else -1


def utf16_to_byte(text: str, line: int, column: int) -> int:
    """Byte of a (line, UTF-16 column) from 0; inside a surrogate pair or beyond the line is an error."""
    lines = text.split("\n")
    if not 0 <= line < len(lines):
        raise ValueError("line outside the text")
    units, at = 0, sum(len(x.encode()) + 1 for x in lines[:line])
    for ch in lines[line]:
        if units >= column:
            break
        units += 2 if ord(ch) > 0xFFFF else 1
        at += len(ch.encode())
    if units != column:
        raise ValueError("column inside a character or outside the line")
    return at


def utf8_cut(data: bytes, n: int) -> bytes:
    """The first n bytes without a split character at the end."""
    return data[:n].decode("utf-8", "ignore").encode()


def utf8_suffix(data: bytes, n: int) -> bytes:
    """The longest valid suffix of at most n bytes."""
    out = data[max(0, len(data) - n) :]
    k = 0
    while k < len(out) and out[k] & 0xC0 == 0x80:
        k += 1
    return out[k:]


def package_name(c: str) -> Column:
    """Lower case, runs of -, _ and . as one hyphen."""
    return F.lower(F.regexp_replace(c, r"[-_.]+", "-"))


def is_relative_path(c: str) -> Column:
    """A path inside its root: no leading slash, no empty, . or .. part, no backslash."""
    return F.coalesce(F.col(c).rlike(r"^[^/\\]+(/[^/\\]+)*$") & ~F.col(c).rlike(r"(^|/)\.\.?(/|$)"), F.lit(False))


def module_path(c: str, ending: str) -> Column:
    """Dots to slashes; null for empty or unsafe parts."""
    return F.when(F.col(c).rlike(r"^[^./\\]+(\.[^./\\]+)*$"), F.concat(F.replace(F.col(c), F.lit("."), F.lit("/")), F.lit(ending)))


def resolve_relative(module: str, is_init: bool, level: int, name: str | None) -> str | None:
    """Absolute name of a relative import; null if it leaves the root."""
    parts = module.split(".")
    keep = len(parts) - level + (1 if is_init else 0)
    base = parts[: max(keep, 0)]
    return ".".join([*base, *([name] if name else [])]) if base else None


def instant(c: str) -> Column:
    """Timestamp of an ISO stamp with Z or an offset; others give null."""
    return F.try_to_timestamp(F.when(F.col(c).rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"), F.col(c)))


def one_line_feed(c: str | Column) -> Column:
    """The payload with exactly one line feed at its end."""
    return F.concat(F.regexp_replace(c, r"\n+\z", ""), F.lit("\n"))


# Comment leaders.
LEADERS = {"lean": "--", "python": "#", "cpp": "//"}


def chunk(payload: str | Column, path: str, lang: str) -> Column:
    """A banner line with the path, then the payload; null for other languages."""
    leader = F.create_map(*[F.lit(x) for kv in LEADERS.items() for x in kv])[F.col(lang)]
    return F.concat(leader, F.lit(" ctx: "), F.col(path), F.lit("\n"), one_line_feed(payload))


def interface(header: Column, lang: Column) -> Column:
    """The header with its body replaced by a mark."""
    bare = F.regexp_replace(header, r"\s+\z", "")
    return F.when(lang == "python", F.concat(bare, F.lit("\n    ...\n"))).when(lang == "lean", F.concat(bare, F.lit(" := by omitted\n"))).otherwise(F.concat(bare, F.lit(" { /* omitted */ }\n")))


def strict_json(text: str) -> dict:
    """An object without repeated keys, NaN or infinities; anything else is an error."""

    def once(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) != len(keys):
            raise ValueError("repeated key")
        return dict(pairs)

    def never(token):
        raise ValueError(f"{token} is no number")

    out = json.loads(text, object_pairs_hook=once, parse_constant=never)
    if not isinstance(out, dict):
        raise ValueError("the root is no object")
    return out


def key_of_identity(lang: str, identity: str) -> str | None:
    """Canonical JSON of an identity: [module, decl] for lean, [module, name, start_byte] for python; null if malformed."""
    try:
        v = json.loads(identity)
    except (TypeError, ValueError):
        return None
    text = isinstance(v, list) and len(v) >= 2 and all(isinstance(x, str) and x for x in v[:2])
    number = text and len(v) == 3 and type(v[2]) is int and v[2] >= 0
    return canonical_json(v) if (lang == "lean" and text and len(v) == 2) or (lang == "python" and number) else None


WORD = re.compile(r"\w+")
