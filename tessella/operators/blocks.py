"""Scores of pairs that share items, in blocks: some queries of a scope against some of its documents at a time.

Documents and queries are rows of a scope with an array of item hashes. A
kernel inverts the documents of its block and adds up what each query and
document have in common, so the single meetings of an item, of which there are
far more than pairs, are never rows of a table. Blocks are bounded on both
sides: no task holds a scope.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.joins import lookup_join
from tessella.scratch import Scratch

#: Documents of a block: SMALL in small scopes, up to LARGE once there are SPREAD blocks.
SMALL, LARGE, SPREAD = 2_000, 20_000, 24
#: Queries of a block, where all pairs are returned and where the best are.
QUERIES, TOP_QUERIES = 1_000, 20_000
#: Sums held at once, meetings added at once, and the share of documents from which an item is added as a dense row.
CELLS, MEETINGS, DENSE = 1 << 20, 1 << 20, 0.12
DENSE_ITEMS = 128
#: Parts of a score count in units of 1e-9, the digits to which they are rounded.
UNIT = 1e9


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a column of arrays."""
    a = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64), a.flatten().to_numpy(zero_copy_only=False)


def _split(sizes: np.ndarray, most: int):
    """Slices of about ``most`` in size, of one element at least."""
    if not len(sizes):
        return
    group = (np.cumsum(sizes) - sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    yield from (slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False))


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... n[0] numbers, then those from start[1], and so on."""
    return np.arange(n.sum()) + np.repeat(start - (np.cumsum(n) - n), n)


class _Block:
    """Queries of a block and the postings of those of its documents' items that they have."""

    def __init__(self, left: pa.Table, right: pa.Table):
        n, items = _lists(left["items"])
        self.size, found = _lists(right["items"])
        self.queries, self.ids = left["query"].to_numpy(), right["id"].to_numpy()
        self.docs, self.n_entries = len(self.ids), n
        vocabulary, self.term = np.unique(items, return_inverse=True)
        at = np.searchsorted(vocabulary, found)
        at[at == len(vocabulary)] = 0
        known = vocabulary[at] == found if len(vocabulary) else np.zeros(len(found), bool)
        doc = np.repeat(np.arange(self.docs), self.size)[known]
        key, self.tf = np.unique(at[known] * self.docs + doc, return_counts=True)
        self.post_term, self.doc = np.divmod(key, max(self.docs, 1))
        self.df = np.bincount(self.post_term, minlength=len(vocabulary))
        self.start = np.cumsum(self.df) - self.df
        self.terms = len(vocabulary)
        order = np.argsort(self.ids, kind="stable")
        own = np.minimum(np.searchsorted(self.ids[order], self.queries), max(self.docs - 1, 0))
        self.own = np.where(self.ids[order][own] == self.queries, order[own], -1) if self.docs else np.full(len(self.queries), -1)

    def chunks(self):
        """Slices of queries and of their entries, with the place of each entry's query in its slice."""
        ends = np.cumsum(self.n_entries)
        for q in _split(np.full(len(self.queries), self.docs), CELLS):
            e = slice(int(ends[q.start] - self.n_entries[q.start]), int(ends[q.stop - 1]))
            yield q, e, np.repeat(np.arange(q.stop - q.start), self.n_entries[q])

    def add(self, sums: np.ndarray, entries: np.ndarray, place: np.ndarray, value=None) -> None:
        """Add, for each entry and document with its item, ``value`` of both (1 without it) to the sum of query and document."""
        n = self.df[self.term[entries]]
        for s in _split(n, MEETINGS):
            at, e, k = _spread(self.start[self.term[entries[s]]], n[s]), np.repeat(entries[s], n[s]), np.repeat(place[s], n[s])
            sums += np.bincount(k * self.docs + self.doc[at], weights=None if value is None else value(e, at), minlength=len(sums)).astype(sums.dtype, copy=False)

    def skip_own(self, sums: np.ndarray, q: slice) -> np.ndarray:
        """The sums as rows of queries; no query meets the document it is."""
        rows = sums.reshape(q.stop - q.start, self.docs)
        has = np.flatnonzero(self.own[q] >= 0)
        rows[has, self.own[q][has]] = 0
        return rows


def _out(query, ids, **values) -> pa.Table:
    parts = {"query": query, "id": ids} | values
    return pa.table({c: np.concatenate(v) if v else np.array([], np.float64 if c == "score" else np.int64) for c, v in parts.items()})


def _overlaps(num: int, den: int, left: pa.Table, right: pa.Table) -> pa.Table:
    b, query, ids, inter, union = _Block(left, right), [], [], [], []
    for q, e, place in b.chunks():
        sums = np.zeros((q.stop - q.start) * b.docs, np.int64)
        b.add(sums, np.arange(e.start, e.stop), place)
        rows = b.skip_own(sums, q)
        i, j = np.nonzero(rows)
        both = rows[i, j]
        either = b.n_entries[q][i] + b.size[j] - both
        keep = both * den >= either * num
        for out, x in ((query, b.queries[q][i]), (ids, b.ids[j]), (inter, both), (union, either)):
            out.append(x[keep])
    return _out(query, ids, n_inter=inter, n_union=union)


def _bm25(k1: float, b: float, avg: float, top: int | None, left: pa.Table, right: pa.Table) -> pa.Table:
    block, query, ids, score = _Block(left, right), [], [], []
    w = _lists(left["w"])[1]
    norm = k1 * (1 - b + b * block.size / avg)
    part = lambda w, tf, doc: np.floor(w * tf * (k1 + 1) / (tf + norm[doc]) * UNIT + 0.5)
    if top is not None:
        best = _best(block, w, norm, k1, top, part)
    for q, e, place in block.chunks():
        if top is None:
            sums = np.zeros((q.stop - q.start) * block.docs)
            block.add(sums, np.arange(e.start, e.stop), place, lambda e, at: part(w[e], block.tf[at], block.doc[at]))
            rows = block.skip_own(sums, q)
            i, j = np.nonzero(rows)
            s = rows[i, j]
        else:
            i, j, s = best(q, e, place)
        for out, x in ((query, block.queries[q][i]), (ids, block.ids[j]), (score, s / UNIT)):
            out.append(x)
    return _out(query, ids, score=score)


def _best(block: _Block, w: np.ndarray, norm: np.ndarray, k1: float, top: int, part):
    """Gives the ``top`` documents of each query of a slice, ties by id.

    All scores are added up in floating point, common items by a product of
    matrices. Rounding parts moves a score by half a unit a part at most, so
    every document of the best lies within twice that of the ``top``-th sum;
    those are added up again, in rounded parts.
    """
    impact = block.tf * (k1 + 1) / (block.tf + norm[block.doc])
    common = np.argsort(-block.df, kind="stable")[:DENSE_ITEMS]
    common = common[block.df[common] > DENSE * block.docs]
    slot = np.full(block.terms, -1)
    slot[common] = np.arange(len(common))
    dense = np.zeros((len(common), block.docs))
    of = slot[block.post_term]
    dense[of[of >= 0], block.doc[of >= 0]] = impact[of >= 0]
    by_doc = np.argsort(block.doc, kind="stable")
    n_doc = np.bincount(block.doc, minlength=block.docs)
    start_doc = np.cumsum(n_doc) - n_doc

    def best(q: slice, e: slice, place: np.ndarray):
        entries, at = np.arange(e.start, e.stop), slot[block.term[e]]
        sums = np.zeros((q.stop - q.start) * block.docs)
        block.add(sums, entries[at < 0], place[at < 0], lambda e, at: w[e] * impact[at])
        if len(common):
            weights = np.zeros((q.stop - q.start, len(common)))
            weights[place[at >= 0], at[at >= 0]] = w[e][at >= 0]
            sums += (weights @ dense).reshape(-1)
        rows = block.skip_own(sums, q)
        least = np.partition(rows, block.docs - top, axis=1)[:, block.docs - top] if block.docs > top else np.zeros(len(rows))
        least = least - block.n_entries[q] * (1 / UNIT + 1e-14 * least) - 1 / UNIT
        i, j = np.nonzero((rows > 0) & (rows >= least[:, None]))
        key = place * block.terms + block.term[e]
        order = np.argsort(key, kind="stable")
        key, mine = key[order], w[e][order]
        exact = np.zeros(len(i))
        for s in _split(n_doc[j], MEETINGS):
            n = n_doc[j[s]]
            post = by_doc[_spread(start_doc[j[s]], n)]
            want = np.repeat(i[s], n) * block.terms + block.post_term[post]
            k = np.minimum(np.searchsorted(key, want), len(key) - 1)
            parts = np.where(key[k] == want, part(mine[k], block.tf[post], block.doc[post]), 0)
            exact[s] = np.bincount(np.repeat(np.arange(len(n)), n), weights=parts, minlength=len(n))
        order = np.lexsort((block.ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        return i[rank < top], j[rank < top], exact[rank < top]

    return best


def _meet(queries: DataFrame, docs: DataFrame, kernel, values: str | None, most: int, more: list[str] | None = None, schema: str | None = None, blocks=None) -> DataFrame:
    """``kernel`` of every block of queries and of documents of the same scope, which get the columns ``more`` too.

    ``blocks``: number of blocks of a scope of ``d`` documents. With
    ``schema``, the result's columns, ``most`` are the pairs of a block, not
    its queries.
    """
    scratch = Scratch(docs.sparkSession)
    count = lambda df, name: df.groupBy("scope").agg(F.count(F.lit(1)).alias(name))
    d, q = F.col("d"), F.col("q")
    if blocks is None:
        blocks = F.greatest(F.ceil(d / LARGE), F.least(F.lit(SPREAD).cast("bigint"), F.ceil(d / SMALL)))
    parts = F.ceil(q / most) if schema is None else F.least(q, F.ceil(q * d / blocks / most))
    grid = scratch.cut(count(docs, "d").join(count(queries, "q"), "scope").select("scope", blocks.alias("blocks"), parts.alias("parts")), "grid")
    n = grid.count()
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # the documents' own columns would be ambiguous
    left = lookup_join(queries, grid, ["scope"], "inner", n).withColumn("part", F.pmod(F.xxhash64("query"), F.col("parts"))).withColumn("block", each("blocks"))
    right = lookup_join(docs, grid, ["scope"], "inner", n).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("part", each("parts"))
    keys = ["scope", "part", "block"]
    schema = schema or "query bigint, id bigint" + f", {values}" * bool(values)
    return left.drop("blocks", "parts").groupBy(*keys).cogroup(right.select(*keys, "id", "items", *(more or [])).groupBy(*keys)).applyInArrow(kernel, schema)


def overlaps(queries: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """``query, id, n_inter, n_union`` of all queries and documents of a scope whose sets have at least num/den of their union in common.

    ``queries``: scope, query, items; ``docs``: scope, id, items; items are
    distinct. A query doesn't meet the document of its own id.
    """
    return _meet(queries, docs, partial(_overlaps, num, den), "n_inter bigint, n_union bigint", QUERIES)


def bm25(docs: DataFrame, wanted: str, top: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``query, id, score`` of the documents that fulfil ``wanted`` against all of their scope with an item in common.

    ``docs``: scope, id, items, an item as often as the document has it.
    Statistics are those of all documents with items, whatever their scope.
    With ``top`` only the best of each query and block are returned, more than
    ``top`` a query: ``similarity.top_k`` has to follow. Scores are those of
    ``similarity.bm25``: sums of parts rounded to nine digits, exact.
    """
    total = docs.where(F.size("items") > 0).agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("items")).alias("avg")).first()
    n, avg = total["n"], total["avg"] or 1.0
    df = docs.select(F.explode(F.array_distinct("items")).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    mine = docs.where(wanted).select("scope", F.col("id").alias("query"), F.explode("items").alias("item")).groupBy("scope", "query", "item").agg(F.count(F.lit(1)).alias("qtf"))
    weight = F.col("qtf") * F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    queries = mine.join(df, "item").groupBy("scope", "query").agg(F.collect_list(F.struct("item", weight.alias("w"))).alias("e")).select("scope", "query", F.col("e.item").alias("items"), F.col("e.w").alias("w"))
    queries = Scratch(docs.sparkSession).cut(queries, "queries")
    return _meet(queries, docs, partial(_bm25, k1, b, avg, top), "score double", QUERIES if top is None else TOP_QUERIES)
