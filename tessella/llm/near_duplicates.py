"""Problem 2: records whose word sets have at least 7/10 of their union in common.

Deletion-variant signatures, exact for set similarity. A set is a bit vector
over the words. Two sets of sizes a and b with that similarity differ in at
most d = floor(3 (a + b) / 17) bits. Cut into m segments with 2 m > d, the
vectors differ by at most one bit in some segment, and then the segment of one
equals that of the other or a variant of it with one word deleted (the one
wildcard). Segments and their one-deletion variants are hashed, joined by
equality, and the candidates are verified on the whole sets.

Segments are cut from the rare words only: what two sets differ by in those is
no more than what they differ by in all. Frequent words, counted over all
records, would only make hot keys. A set spends on each segment nothing, one
unit (equality) or two (one deletion) and needs d + 1 units in all. The few
sets that have too few rare words for that take another exact way: their d + 1
first words in the order rare-then-hash, of which at least one is among the
first words of any partner.

Sets of one size class and the next share a cut, so partners always meet.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.joins import lookup_join
from tessella.scratch import Scratch

WORD = re.compile(r"[A-Za-z0-9_]+")
#: A word is frequent if more than this share of the sets holds it. What counts as frequent changes the candidates, never the result.
FREQUENT = 0.001
#: Of these at most so many are told apart, the most frequent ones.
MOST_FREQUENT = 100_000
#: Rows of one signature that meet in one task; a larger block is joined block by block, spread over tasks.
BLOCK = 2_000
#: Segments per class, as a share of its largest size.
CUT = 0.40
#: Candidate ids are sent to all tasks up to this number, beyond it they are joined.
SEND_IDS = 100_000
#: Copies of one set that make it worth to keep one record of each first.
HOT = 1_000

_U = np.uint64


def word_hashes(text: str) -> np.ndarray:
    """Distinct words of a text as sorted 64-bit hashes."""
    h = xxhash.xxh3_64_intdigest
    return np.sort(np.array([h(w) for w in set(WORD.findall(text))], np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _set_key(hashes: np.ndarray, text: str) -> int:
    """The same for the same word set; sets without words go by their text."""
    data = hashes.tobytes() if len(hashes) else b"\0" + text.encode()
    return int(np.uint64(xxhash.xxh3_64_intdigest(data)).astype(np.int64))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if key is not None and text is not None:
            yield key, text


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind 0, record, set key, size) and (kind 1, word hash, 0, count) of locally frequent words."""
    tally: Counter = Counter()
    total = 0
    for batch in batches:
        rows = []
        for key, text in _texts(batch):
            hashes = word_hashes(text)
            tally.update(hashes.tolist())
            total += 1
            rows.append((0, key, _set_key(hashes, text), len(hashes)))
        if len(tally) > 500_000:
            tally = Counter({w: n for w, n in tally.items() if n > 1 and n >= FREQUENT * total / 2})
        yield _survey_rows(rows)
    least = max(3, FREQUENT * total)
    yield _survey_rows([(1, int(np.uint64(w).astype(np.int64)), 0, n) for w, n in tally.items() if n >= least])


def _survey_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds, a, b, n = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(n, pa.int64())], names=["kind", "a", "b", "n"])


def _class_of(size: np.ndarray) -> np.ndarray:
    """Class k holds the sizes 2**k to 2**(k+1) - 1."""
    return np.floor(np.log2(np.maximum(size, 1))).astype(np.int64)


def _need(size: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """Units for partners no smaller than the set and no larger than ``largest``."""
    return 3 * (size + np.minimum(largest, size * 10 // 7)) // 17 + 1


def _rank_in(group: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Place of each entry among those of its group, in the given order."""
    rank = np.empty(len(group), np.int64)
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.empty(0, np.int64)
    rank[order] = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return rank


class _Rows:
    def __init__(self):
        self.parts: list[tuple] = []

    def add(self, key, unit, want, kind):
        self.parts.append((key, unit, want, kind))

    def batch(self, ids, sizes, bits) -> pa.RecordBatch:
        key, unit, want, kind = (np.concatenate(x) for x in zip(*self.parts))
        unit = unit.astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array((key >> _U(24)).astype(np.int64)),
                pa.array(ids[unit]),
                pa.array(bits[unit].view(np.int64)),
                pa.array((sizes[unit] << 4 | want.astype(np.int64) << 2 | kind.astype(np.int64)).astype(np.int32)),
            ],
            names=["key", "id", "bits", "meta"],
        )


def _segments(words: np.ndarray, unit: np.ndarray, cls: np.ndarray, size: np.ndarray, largest: np.ndarray, index: bool, rows: _Rows) -> np.ndarray:
    """Signatures of one cut; the units that cannot pay for their need.

    ``words`` and ``unit``: rare words with the number of their unit. ``cls``,
    ``size``, ``largest`` per unit. ``index``: partners find these rows too.
    """
    m = np.maximum(1, np.ceil(CUT * 2.0 ** (cls + 1))).astype(np.int64)
    seg = ((words >> _U(17)) % m[unit].astype(np.uint64)).astype(np.int64)
    group = unit.astype(np.int64) << 24 | seg
    order = np.argsort(group, kind="stable")
    group, words = group[order], words[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    count = np.diff(np.r_[first, len(group)])
    whole = np.bitwise_xor.reduceat(words, first) if len(first) else np.empty(0, np.uint64)
    head = group[first]
    owner = head >> 24
    salt = _mix((head & 0xFFFFFF).astype(np.uint64) << _U(8) | cls[owner].astype(np.uint64))
    have = np.bincount(owner, minlength=len(size))
    pairs = np.bincount(owner, count > 1, minlength=len(size)).astype(np.int64)
    need = _need(size, largest)
    extra = np.maximum(0, need - have)
    failed = extra > pairs
    # equality on the largest segments first, one deletion on the smallest of two words or more
    by_large = _rank_in(owner, np.lexsort((-count, owner)))
    by_small = _rank_in(owner, np.lexsort((count, count == 1, owner)))
    ok = ~failed[owner]
    probe = ok & (by_large < need[owner])
    two = ok & (count > 1) & (by_small < extra[owner])
    want = np.where(two, 3, np.where(probe, 1, 0))
    keep = slice(None) if index else want > 0
    rows.add(_mix(whole ^ salt)[keep], owner[keep], want[keep], np.full(len(owner), int(index))[keep])
    at = np.repeat(np.arange(len(first)), count)
    variants = (count[at] > 1) & (index | two[at])
    at, gone = at[variants], words[variants]
    rows.add(_mix(whole[at] ^ gone ^ salt[at]), owner[at], two[at].astype(np.int64), np.full(len(at), 2 * int(index)))
    return failed


def _order_key(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Place in the global order: rare words by hash, then frequent ones by how frequent they are."""
    place = np.searchsorted(frequent["h"], words)
    place[place == len(frequent)] = 0
    common = frequent["h"][place] == words if len(frequent) else np.zeros(len(words), bool)
    return np.where(common, _U(1 << 63) + (frequent["n"][place] if len(frequent) else _U(0)), words >> _U(1))


def _flatten(batch: pa.RecordBatch, seen: set[int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, sizes, words, unit of the records of a batch with a word set that the task has not had."""
    ids, sets = [], []
    for key, text in _texts(batch):
        hashes = word_hashes(text)
        if not len(hashes):
            continue
        if seen is not None:
            k = _set_key(hashes, text)
            if k in seen:
                continue
            seen.add(k)
        ids.append(key)
        sets.append(hashes)
    sizes = np.array([len(s) for s in sets], np.int64)
    words = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    return np.array(ids, np.int64), sizes, words, np.repeat(np.arange(len(sets)), sizes)


def _parity(words: np.ndarray, unit: np.ndarray, n: int) -> np.ndarray:
    """64 bits per set; a word flips one, so sets differ in at least as many words as bits."""
    first = np.searchsorted(unit, np.arange(n))
    return np.bitwise_xor.reduceat(_U(1) << (words & _U(63)), first) if n else np.empty(0, np.uint64)


def _signatures(frequent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        seen: set[int] = set()
        for batch in batches:
            ids, sizes, words, unit = _flatten(batch, seen)
            if not len(ids):
                continue
            bits = _parity(words, unit, len(ids))
            rare = ~np.isin(words, common["h"])
            words, unit = words[rare], unit[rare]
            cls = _class_of(sizes)
            rows = _Rows()
            top = 2 ** (cls + 1) - 1
            failed = _segments(words, unit, cls, sizes, top, True, rows)
            up = sizes * 10 // 7 > top
            inside = up[unit]
            failed |= up & _segments(words[inside], unit[inside], cls + 1, sizes, sizes * 10 // 7, False, rows)
            yield rows.batch(ids, sizes, bits)
            lost = np.flatnonzero(failed)
            if len(lost):  # a mark below zero that meets itself alone
                mark = (_mix(ids[lost].view(np.uint64)) | _U(1 << 63)).view(np.int64)
                meta = (sizes[lost] << 4 | 5).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(mark), pa.array(ids[lost]), pa.array(bits[lost].view(np.int64)), pa.array(meta)], names=["key", "id", "bits", "meta"])

    return run


def _first_words(frequent, sought) -> Callable:
    """First words of sets as rows: of the late sets (third column) all, of others what is sought."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        words_sought = sought.value if sought else None
        for batch in batches:
            late = {k for k, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()) if x}
            ids, sizes, words, unit = _flatten(batch, None)
            if not len(ids):
                continue
            bits = _parity(words, unit, len(ids))
            mine = np.fromiter((k in late for k in ids.tolist()), bool, len(ids))
            rank = _rank_in(unit, np.lexsort((_order_key(words, common), unit)))
            pick = rank < (3 * sizes // 10 + 1)[unit]  # size - ceil(0.7 size) + 1
            if words_sought is not None:
                pick &= mine[unit] | np.isin(words, words_sought)
            rows = _Rows()
            rows.add(_mix(words[pick]), unit[pick], mine[unit[pick]].astype(np.int64), np.ones(pick.sum(), np.int64))
            yield rows.batch(ids, sizes, bits)

    return run


def _first_words_of(frequent) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = frequent.value
        for batch in batches:
            _, sizes, words, unit = _flatten(batch, None)
            rank = _rank_in(unit, np.lexsort((_order_key(words, common), unit)))
            pick = rank < (3 * sizes // 10 + 1)[unit] if len(sizes) else np.empty(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(words[pick].view(np.int64))], names=["word"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, words, _ = _flatten(batch, None)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(offsets), pa.array(words.view(np.int64)))], names=["id", "words"])


_SCHEMA = "key bigint, id bigint, bits bigint, meta int"
_MATCH = (
    "l.key = r.key and (shiftright(l.meta, 2) & r.meta & 3) <> 0"
    " and (shiftright(l.meta, 4) < shiftright(r.meta, 4) or (shiftright(l.meta, 4) = shiftright(r.meta, 4)"
    " and l.id < r.id + shiftrightunsigned(l.key & r.key, 63)))"
    " and 7 * shiftright(r.meta, 4) <= 10 * shiftright(l.meta, 4)"
    " and bit_count(l.bits ^ r.bits) <= (3 * (shiftright(l.meta, 4) + shiftright(r.meta, 4))) div 17"
)


def _meet(rows: DataFrame, scratch: Scratch, most: float) -> DataFrame:
    """Candidate pairs of the signatures; ``most`` bounds the rows of one signature."""
    # symmetric in form, so that both sides are the same exchange
    pairs = lambda x: x.alias("l").join(x.alias("r"), F.expr(_MATCH)).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    if most <= BLOCK:
        return pairs(rows)
    rows = scratch.cut(rows, "signatures")
    large = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("k")).where("k > 1")
    marked = lookup_join(rows, scratch.cut(large, "large"), ["key"])
    inside = marked.where("k is not null").withColumn("own", F.pmod(F.xxhash64("id"), F.col("k")))
    parts = F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)
    left = inside.withColumns({"x": F.col("own"), "y": F.explode(parts)}).alias("l")
    right = inside.withColumns({"y": F.col("own"), "x": F.explode(parts)}).alias("r")
    spread = left.join(right, F.expr("l.x = r.x and l.y = r.y and " + _MATCH)).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
    return pairs(marked.where("k is null").select("key", "id", "bits", "meta")).unionByName(spread)


def near_duplicates(records: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Members and links.

    Members: ``id, class_id``, one row per distinct id with a text; records
    with the same word set have one class, named by its smallest id. Links:
    ``class_a, class_b`` (a < b), each pair of classes whose sets have at
    least 7/10 of their union in common. A record without id or text is left
    out; texts without a word are alike only if equal. A repeated row counts
    once. Other columns are ignored.
    """
    spark = records.sparkSession
    scratch = Scratch(spark)
    base = records.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    survey = scratch.cut(base.mapInArrow(_survey, "kind int, a bigint, b bigint, n bigint"), "survey")
    owners = survey.where("kind = 0").select(F.col("a").alias("id"), F.col("b").alias("set_key"), F.col("n").alias("size")).distinct()
    classes = scratch.cut(owners.groupBy("set_key").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("members"), F.max("size").alias("size")), "classes")
    n_sets, most = classes.agg(F.count(F.lit(1)), F.max("members")).first()
    members = scratch.cut(owners.join(classes.select("set_key", "class_id"), "set_key").select("id", "class_id"), "members")
    counted = survey.where("kind = 1").groupBy(F.col("a").alias("h")).agg(F.sum("n").alias("n")).where(F.col("n") >= max(3.0, FREQUENT * n_sets / 2))
    found = counted.orderBy(F.desc("n"), "h").limit(MOST_FREQUENT).collect()
    common = np.sort(np.array([(np.int64(r["h"]).view(np.uint64), r["n"]) for r in found], dtype=[("h", "<u8"), ("n", "<u8")]), order="h")
    sc = spark.sparkContext
    frequent = sc.broadcast(common)
    if most and most > HOT:
        base = base.join(classes.select(F.col("class_id").alias("id")), "id", "left_semi")
    # a signature holds at least one rare word, and a set has at most two rows of one signature
    most = 2 * (int(found[-1]["n"]) if len(found) == MOST_FREQUENT else max(3.0, FREQUENT * n_sets))
    pairs = scratch.cut(_meet(base.mapInArrow(_signatures(frequent), _SCHEMA), scratch, most).distinct(), "pairs")
    pairs = _with_late(scratch, base, frequent, pairs)
    links = _verify(scratch, base, pairs)
    known = members.select("id", "class_id")
    links = (
        links.join(known.withColumnsRenamed({"id": "a", "class_id": "ca"}), "a")
        .join(known.withColumnsRenamed({"id": "b", "class_id": "cb"}), "b")
        .where("ca <> cb")
        .select(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b"))
        .distinct()
    )
    return members, scratch.cut(links, "links")


def _with_late(scratch: Scratch, base: DataFrame, frequent, pairs: DataFrame) -> DataFrame:
    """The candidates, with those of the sets that could not pay for their need."""
    late = pairs.where("a = b").select(F.col("a").alias("id")).distinct()
    n = late.count()
    met = pairs.where("a <> b")
    if not n:
        return met
    late = F.broadcast(late) if n <= SEND_IDS else late
    probes = base.join(late, "id", "left_semi").mapInArrow(_first_words_of(frequent), "word bigint").distinct()
    few = probes.limit(SEND_IDS + 1).toPandas()["word"].to_numpy(np.int64)
    sought = base.sparkSession.sparkContext.broadcast(np.sort(few.view(np.uint64))) if len(few) <= SEND_IDS else None
    marked = base.join(late.withColumn("late", F.lit(True)), "id", "left").select("id", "text", "late")
    return scratch.cut(met.union(_meet(marked.mapInArrow(_first_words(frequent, sought), _SCHEMA), scratch, float("inf"))).distinct(), "pairs")


def _verify(scratch: Scratch, base: DataFrame, pairs: DataFrame) -> DataFrame:
    ids = scratch.cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    n = ids.count()
    sets = base.join(F.broadcast(ids) if n <= SEND_IDS else ids, "id", "left_semi").mapInArrow(_sets, "id bigint, words array<bigint>")
    both = F.size(F.array_intersect("wa", "wb"))
    return (
        pairs.join(sets.select(F.col("id").alias("a"), F.col("words").alias("wa")), "a")
        .join(sets.select(F.col("id").alias("b"), F.col("words").alias("wb")), "b")
        .withColumn("common", both)
        .where(F.col("common") * 17 >= 7 * (F.size("wa") + F.size("wb")))
        .select("a", "b")
    )
