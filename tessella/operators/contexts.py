"""Orders of the units around a target in block kernels: texts as codes, names, likely twins, ranks.

A text is read once. Its words and grams are 64-bit hashes from there on, and
records that are only compared are digests. What a target and the units of its
repo have in common is added up in blocks (``operators/blocks.py``), and a
block leaves its order, not its pairs: no pair is shuffled, and the sha256 of
a pair is taken only where it decides.
"""

from __future__ import annotations

import re
from functools import partial
from hashlib import blake2b, sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import similarity as S
from tessella.operators.blocks import LARGE, QUERIES, UNIT, _Block, _lists, _meet, _split, _spread

#: Bytes of text and codes that a worker holds at once.
TEXT, CODES = 1 << 22, 1 << 19
#: Scopes of up to WHOLE documents are ranked in one block; pairs of a block's result.
WHOLE, PAIRS = 100_000, 1 << 21
#: Factors of the records of a gram, odd.
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
SIGN = 1 << 62
_FIRST = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_RECORD = re.compile(S.TOKEN, re.ASCII)

CODED = "unit bigint, repo string, file bigint, name bigint, words array<bigint>, verb binary, norm binary, gset binary, n bigint, grams array<bigint>"


def _hash(token: str) -> bytes:
    return blake2b(token.encode(), digest_size=8).digest()


class _Codes(dict):
    """Numbers of tokens, with their hashes and whether they are words."""

    def __init__(self):
        self.hash, self.word = bytearray(), bytearray()

    def __missing__(self, token: str) -> int:
        self[token] = n = len(self.word)
        self.hash += _hash(token)
        self.word.append(token[0] in _FIRST)
        return n


def _listed(parts: list) -> pa.ListArray:
    n = np.array([0 if x is None else len(x) for x in parts], np.int64)
    values = np.concatenate([x for x in parts if x is not None and len(x)] or [np.array([], np.int64)]).astype(np.int64, copy=False)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(values))


def _slice(codes: _Codes, whole: bool, units: list, texts: list, others: list) -> dict:
    lists = [_RECORD.findall(t) for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    code = np.fromiter(map(codes.__getitem__, chain.from_iterable(lists)), np.int64, n.sum())
    more = {i: sorted({codes[t] for t in _RECORD.findall(o)}) for i, o in enumerate(others) if o is not None}
    hashes, is_word = np.frombuffer(bytes(codes.hash), np.int64), np.frombuffer(bytes(codes.word), bool)
    h, word, end = hashes[code], is_word[code], np.cumsum(n)
    key = np.repeat(np.arange(len(n)), n)[word] * len(codes) + code[word]
    own, first, back = np.unique(key, return_index=True, return_inverse=True)
    n_words = np.bincount(own // max(len(codes), 1), minlength=len(n))
    place = np.empty(len(own), np.int64)
    place[np.argsort(first)] = np.arange(len(own)) - np.repeat(np.cumsum(n_words) - n_words, n_words)
    words = np.split(hashes[own % max(len(codes), 1)], np.cumsum(n_words)[:-1])
    for i, found in more.items():
        words[i] = hashes[[c for c in found if is_word[c]]]
    normed = h | SIGN
    normed[word] = place[back]
    u = h.view(np.uint64)
    runs = sum(u[k : len(u) - len(FACTORS) + 1 + k] * f for k, f in enumerate(FACTORS)) if len(u) >= len(FACTORS) else u
    digest = lambda x: blake2b(x.tobytes(), digest_size=16).digest()
    gsets, sizes, grams = [], [], []
    for unit, a, b in zip(units, (end - n).tolist(), end.tolist(), strict=True):
        g = np.unique(runs[a : b - len(FACTORS) + 1]) if b - a >= S.LEAST_RECORDS else None
        gsets.append(None if g is None else digest(g))
        sizes.append(0 if g is None else len(g))
        # of sets that are alike, any so many grams of the one have one of the other
        grams.append(g if g is None or whole or unit % 50 == 0 else g[: len(g) - -(-len(g) * S.NUM // S.DEN) + 1])
    each = [(a, b) for a, b in zip((end - n).tolist(), end.tolist(), strict=True)]
    return {
        "words": _listed(words), "verb": pa.array([digest(h[a:b]) for a, b in each], pa.binary()), "norm": pa.array([digest(normed[a:b]) for a, b in each], pa.binary()),
        "gset": pa.array(gsets, pa.binary()), "n": pa.array(sizes, pa.int64()), "grams": _listed([None if g is None else g.view(np.int64) for g in grams]),
    }


def _code(whole: bool, batches):
    codes = _Codes()
    for batch in batches:
        size = pc.add(pc.binary_length(batch["payload"]), pc.fill_null(pc.binary_length(batch["other"]), 0)).to_numpy(zero_copy_only=False)
        for s in _split(size, TEXT):
            part = batch.slice(s.start, s.stop - s.start)
            if len(codes) > CODES:
                codes = _Codes()
            new = _slice(codes, whole, part["unit"].to_pylist(), part["payload"].to_pylist(), part["other"].to_pylist())
            name = pa.array([None if x is None else int.from_bytes(_hash(x), "little", signed=True) for x in part["name"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_pydict({"unit": part["unit"], "repo": part["repo"], "file": part["file"], "name": name} | new)


def coded(rows: DataFrame, whole: bool = False) -> DataFrame:
    """Codes of texts: hashes of words and name, digests of records, normalised records and gram set, the set's size and grams.

    ``rows``: unit, repo, file, name, payload, other (the text whose words
    count instead of the payload's, or null). Of texts of too few records
    there are no grams. ``grams`` has all of targets, or of all texts with
    ``whole``, otherwise as many as one of which every set alike must have.
    """
    return rows.select("unit", "repo", "file", "name", "payload", "other").mapInArrow(partial(_code, whole), CODED)


def _named(left: pa.Table, right: pa.Table) -> pa.Table:
    name, dst = left["name"].to_numpy(), left["query"].to_numpy()
    order = np.argsort(name, kind="stable")
    n, words = _lists(right["items"])
    low, high = (np.searchsorted(name[order], words, side) for side in ("left", "right"))
    ids = np.repeat(np.repeat(right["id"].to_numpy(), n), high - low)
    found = dst[order][_spread(low, high - low)]
    return pa.table({"query": found[found != ids], "id": ids[found != ids]})


def named(names: DataFrame, docs: DataFrame) -> DataFrame:
    """``src, dst``: units that have the name of another of their scope among their words. ``names``: scope, query, name; ``docs``: scope, id, items."""
    return _meet(names, docs, _named, "", LARGE).select(F.col("id").alias("src"), F.col("query").alias("dst"))


def _likely(num: int, den: int, left: pa.Table, right: pa.Table) -> pa.Table:
    b, query, ids = _Block(left, right), [], []
    n_query, n_doc = left["n"].to_numpy(), right["n"].to_numpy()
    for q, e, place in b.chunks():
        sums = np.zeros((q.stop - q.start) * b.docs, np.int64)
        b.add(sums, np.arange(e.start, e.stop), place)
        rows = b.skip_own(sums, q)
        i, j = np.nonzero(rows)
        x, y = n_query[q][i], n_doc[j]
        # sets alike have so many grams in common; of the kept ones at most the rest of the document's are missing
        both = -(-num * (x + y) // (num + den))
        near = (np.minimum(x, y) >= both) & (rows[i, j] >= b.size[j] - (y - both))
        query.append(b.queries[q][i[near]])
        ids.append(b.ids[j[near]])
    return pa.table({c: np.concatenate(v) if v else np.array([], np.int64) for c, v in (("query", query), ("id", ids))})


def likely(queries: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """``query, id`` of a scope that may have num/den of their grams in common, by the grams that ``coded`` keeps and by size."""
    return _meet(queries, docs, partial(_likely, num, den), "", QUERIES, more=["n"])


def _digests(prefix: str, units: list[bytes]) -> np.ndarray:
    """sha256 of the prefix and each unit, as rows of four numbers in the order of their hex."""
    start = prefix.encode()
    return np.frombuffer(b"".join([sha256(start + u).digest() for u in units]), ">u8").reshape(-1, 4)


def _text(units: np.ndarray) -> list[bytes]:
    return [b"%d" % u for u in units.tolist()]


def _order(values: np.ndarray, units: np.ndarray, prefix: str, down: bool = False) -> np.ndarray:
    """Places by ascending value, ties by the hash of prefix and unit, ``down`` from the largest, then by unit."""
    order = np.argsort(values, kind="stable")
    same = values[order][1:] == values[order][:-1]
    tied = np.zeros(len(order), bool)
    tied[1:] |= same
    tied[:-1] |= same
    if tied.any():
        at = order[tied]
        h = _digests(prefix, _text(units[at])).astype(np.uint64)
        h = ~h if down else h
        order[tied] = at[np.lexsort((units[at], h[:, 3], h[:, 2], h[:, 1], h[:, 0], values[at]))]
    return order


def _files(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    return pc.fill_null(column, 0).to_numpy(), pc.is_valid(column).to_numpy()


def _around(k1: float, b: float, avg: float, left: pa.Table, right: pa.Table):
    """Of each query of a block: its number, the documents, the scores of all in units and which may be shown, and a lookup of places by id."""
    block = _Block(left, right)
    w = _lists(left["w"])[1]
    norm = k1 * (1 - b + b * block.size / avg)
    part = lambda e, at: np.floor(w[e] * block.tf[at] * (k1 + 1) / (block.tf[at] + norm[block.doc[at]]) * UNIT + 0.5)
    (file, has), (mine, known) = _files(right["file"]), _files(left["file"])
    n, hidden = _lists(left["hidden"])
    ends = np.cumsum(n)
    order = np.argsort(block.ids, kind="stable")
    ids = block.ids[order]

    def places(units: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(ids, units), len(ids) - 1)
        return order[at[ids[at] == units]]

    for q, e, place in block.chunks() if block.docs else ():
        sums = np.zeros((q.stop - q.start) * block.docs)
        block.add(sums, np.arange(e.start, e.stop), place, part)
        for i, row in zip(range(q.start, q.stop), sums.reshape(-1, block.docs), strict=True):
            shown = ~(has & (file == mine[i])) if known[i] else np.ones(block.docs, bool)
            shown[places(hidden[ends[i] - n[i] : ends[i]])] = False
            if block.own[i] >= 0:
                shown[block.own[i]] = False
            yield i, int(block.queries[i]), block.ids, row, shown, places


def _table(schema: pa.Schema, rows: list) -> pa.Table:
    return pa.table([np.concatenate([r[k] for r in rows]) if rows else np.array([], t.to_pandas_dtype()) for k, t in enumerate(schema.types)], schema=schema)


_RANKS = pa.schema([("target", pa.int64()), ("unit", pa.int64()), ("position", pa.int32())])
_SCORES = pa.schema([("target", pa.int64()), ("unit", pa.int64()), ("score", pa.float64())])
_BEST = pa.schema([("arm", pa.int32()), ("seed", pa.int32()), ("target", pa.int64()), ("unit", pa.int64()), ("score", pa.float64())])


def _placed(target: int, units: np.ndarray, scores: np.ndarray) -> tuple:
    order = _order(scores, units, f"k6tie:{target}:", down=True)
    return np.full(len(units), target), units[order], np.arange(1, len(units) + 1, dtype=np.int32)


def _ranks(k1: float, b: float, avg: float, left: pa.Table, right: pa.Table) -> pa.Table:
    return _table(_RANKS, [_placed(t, ids[shown], row[shown]) for _, t, ids, row, shown, _ in _around(k1, b, avg, left, right)])


def _scores(k1: float, b: float, avg: float, left: pa.Table, right: pa.Table) -> pa.Table:
    return _table(_SCORES, [(np.full(shown.sum(), t), ids[shown], row[shown]) for _, t, ids, row, shown, _ in _around(k1, b, avg, left, right)])


def _one(rows: pa.Table) -> pa.Table:
    return _table(_RANKS, [_placed(rows["target"][0].as_py(), rows["unit"].to_numpy(), rows["score"].to_numpy())])


def _best(k1: float, b: float, avg: float, seeds: tuple, top: int, left: pa.Table, right: pa.Table) -> pa.Table:
    n, needed = _lists(left["needed"])
    ends, out = np.cumsum(n), []

    def add(arm: int, seed: int, target: int, units: np.ndarray, scores: np.ndarray) -> None:
        out.append((np.full(len(units), arm, np.int32), np.full(len(units), seed, np.int32), np.full(len(units), target), units, scores))

    for i, t, ids, row, shown, places in _around(k1, b, avg, left, right):
        at = np.flatnonzero(shown)
        if len(at) > top:  # ties with the last of the best stay for the hash
            at = at[row[at] >= np.partition(row[at], len(at) - top)[len(at) - top]]
        at = at[_order(-row[at], ids[at], f"k6tie:{t}:")][:top]
        add(6, 0, t, ids[at], row[at])
        shown[places(needed[ends[i] - n[i] : ends[i]])] = False
        pool = ids[shown]
        text = _text(pool)
        for seed in seeds:
            h = _digests(f"k5:{seed}:{t}:", text)
            at = np.arange(len(pool))
            if len(pool) > top:
                first = h[:, 0].astype(np.uint64)
                at = np.flatnonzero(first <= np.partition(first, top - 1)[top - 1])
            at = at[np.lexsort((pool[at], *h[at].T[::-1]))][:top]
            add(5, seed, t, pool[at], np.zeros(len(at)))
    return _table(_BEST, out)


def _sql(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({pa.int64(): 'bigint', pa.int32(): 'int', pa.float64(): 'double'})[f.type]}" for f in schema)


def weighted(docs: DataFrame, targets: DataFrame) -> tuple[DataFrame, float]:
    """Targets with ``items, w``, the words of each and their BM25 weights by all documents; the mean number of words."""
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("items")).alias("avg")).first()
    df = docs.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(1 + (total["n"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mine = targets.select("query", F.explode("items").alias("item")).join(df, "item").groupBy("query").agg(F.collect_list(F.struct("item", weight.alias("w"))).alias("e"))
    none = lambda c: F.coalesce(c, F.array())
    return targets.drop("items").join(mine, "query", "left").select(*[c for c in targets.columns if c != "items"], none("e.item").alias("items"), none("e.w").alias("w")), total["avg"] or 1.0


def ranked(queries: DataFrame, docs: DataFrame, avg: float, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``target, unit, position``: what may be shown to each query, by ascending score, ties by descending hash, then unit.

    ``queries``: scope, query, items, w, file, hidden (units); ``docs``:
    scope, id, items, file. A document isn't shown to a query that is itself,
    of the same file or hides it. One without an item in common scores 0. A
    scope is ranked where it is scored; only scopes of more than WHOLE
    documents are scored in blocks, and their scores meet by query.
    """
    large = [r["scope"] for r in docs.groupBy("scope").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WHOLE).collect()]
    of = lambda df, yes: df.where(F.col("scope").isin(large) == yes) if large else df
    out = _meet(of(queries, False), of(docs, False), partial(_ranks, k1, b, avg), None, PAIRS, more=["file"], schema=_sql(_RANKS), blocks=F.lit(1).cast("bigint"))
    if large:
        scores = _meet(of(queries, True), of(docs, True), partial(_scores, k1, b, avg), None, PAIRS, more=["file"], schema=_sql(_SCORES), blocks=F.ceil(F.col("d") / LARGE))
        out = out.unionByName(scores.groupBy("target").applyInArrow(_one, _sql(_RANKS)))
    return out


def nearest(queries: DataFrame, docs: DataFrame, avg: float, seeds: tuple, top: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``arm, seed, target, unit, score``: the first ``top`` of each block in the random orders (arm 5) and the ranked one (arm 6).

    As ``ranked``; ``queries`` have also ``needed``, units that are not drawn
    at random. The best of all blocks are among those of each.
    """
    return _meet(queries, docs, partial(_best, k1, b, avg, seeds, top), None, PAIRS, more=["file"], schema=_sql(_BEST), blocks=F.ceil(F.col("d") / LARGE))
