"""Problem 6: the whole corpus as ids of a public byte-level BPE vocabulary.

The words of the corpus are counted; the frequent ones are encoded once and
compiled into a transducer lexicon (``lexicon.py``), which is written to the
shared folder, sent to the executors as a file and memory-mapped there. Words
it lacks are merged exactly. The lexicon only saves work: the ids are the same
whatever it holds.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.lexicon import MAX_BYTES, Lexicon, build
from tessella.scratch import Scratch, write_bytes

# The pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Words in the lexicon at most; the driver holds them while it builds it.
LEXICON_WORDS = 60_000
#: Words that a Python worker remembers.
CACHE_WORDS = 300_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one word: always merge the pair of lowest rank, the leftmost first.

    A heap over a linked list keeps this in n log n for words of any length.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        left = parts[i]
        j = after[i]
        if left is None or j >= n or len(left) + len(parts[j]) != size:
            continue
        parts[i], parts[j] = left + parts[j], None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            pair = parts[i] + parts[k]
            if (r := ranks.get(pair)) is not None:
                heapq.heappush(heap, (r, i, len(pair)))
        if (h := before[i]) >= 0:
            pair = parts[h] + parts[i]
            if (r := ranks.get(pair)) is not None:
                heapq.heappush(heap, (r, h, len(pair)))
    return [ranks[p] for p in parts if p is not None]


class Encoder:
    """Splits texts into words and gives their ids from the lexicon or by merging."""

    def __init__(self, ranks_path: str, lexicon_path: str | None = None):
        self.ranks = read_ranks(ranks_path)
        self.lexicon = Lexicon(lexicon_path) if lexicon_path else None
        self.split = regex.compile(PATTERN).findall
        self.known: dict[str, list[int]] = {}

    def words(self, texts: list[str]) -> list[list[str]]:
        out = [self.split(t) for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        new = list(set().union(*out).difference(self.known))
        raw = [w.encode() for w in new]
        ranks = self.lexicon.look_up(raw).tolist() if self.lexicon else [-1] * len(raw)
        for word, data, rank in zip(new, raw, ranks):
            self.known[word] = self.lexicon.ids_of(rank) if rank >= 0 else merge(data, self.ranks)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words([text])[0] for i in self.known[w]]


_ENCODERS: dict[tuple, Encoder] = {}


def _encoder(ranks_file: str, lexicon_file: str) -> Encoder:
    key = (ranks_file, lexicon_file)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(SparkFiles.get(ranks_file), SparkFiles.get(lexicon_file))
    return _ENCODERS[key]


def _chunks(column: pa.Array, size: int = 4_000_000) -> Iterator[tuple[int, list[str]]]:
    """Texts of a batch in groups of about ``size`` characters; null counts as empty."""
    start, group, total = 0, [], 0
    for k in range(len(column)):
        text = column[k].as_py() or ""
        group.append(text)
        total += len(text)
        if total >= size:
            yield start, group
            start, group, total = k + 1, [], 0
    if group:
        yield start, group


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    split = regex.compile(PATTERN).findall
    tally: Counter = Counter()

    def flush():
        kept = {w: n for w, n in tally.items() if len(w.encode()) <= MAX_BYTES}
        tally.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for _, texts in _chunks(batch.column(0)):
            for text in texts:
                tally.update(split(text))
            if len(tally) > CACHE_WORDS:
                yield flush()
    yield flush()


def build_lexicon(documents: DataFrame, text_col: str = "text", ranks_path: str | None = None, words: int = LEXICON_WORDS) -> tuple[str, str]:
    """Count all words, compile the ``words`` most frequent; the names of the two files on the executors."""
    spark = documents.sparkSession
    ranks_path = ranks_path or vocabulary_path()
    top = (
        documents.where(F.length(text_col) > 0)
        .select(text_col)
        .mapInArrow(_count_words, "word string, n bigint")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where("n > 1")
        .orderBy(F.desc("n"), "word")
        .limit(words)
        .select("word")
        .collect()
    )
    ranks = read_ranks(ranks_path)
    raw = [r["word"].encode() for r in top]
    path = Scratch(spark).path("lexicon") + ".bin"
    write_bytes(spark, path, build({w: merge(w, ranks) for w in raw}))
    spark.sparkContext.addFile(path)
    name = path.rsplit("/", 1)[1]
    _send(spark, ranks_path)
    return ranks_path.rsplit("/", 1)[1], name


def _send(spark: SparkSession, path: str) -> None:
    sent = spark.sparkContext._jsc.sc().listFiles()
    name = path.rsplit("/", 1)[1]
    if not any(sent.apply(i).endswith("/" + name) for i in range(sent.size())):
        spark.sparkContext.addFile(path)


def _id_batches(ranks_file: str, lexicon_file: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(ranks_file, lexicon_file)
        for batch in batches:
            for start, texts in _chunks(batch.column(1)):
                values, sizes = array("i"), []
                for words in coder.words(texts):
                    before = len(values)
                    values.extend(chain.from_iterable(map(coder.known.__getitem__, words)))
                    sizes.append(len(values) - before)
                values = np.frombuffer(values, np.int32) if values else np.empty(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), lists], names=["key", "ids"])

    return run


def encode(documents: DataFrame, key_col: str, text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """``key_col`` and ``ids`` (array<int>), one row per row of ``documents``.

    Null and empty texts have the empty list. Strings that look like special
    tokens are ordinary text. Blank texts keep the ids of their blanks.
    Repeated rows give repeated rows; other columns are dropped.
    """
    names = build_lexicon(documents, text_col, ranks_path)
    kind = documents.schema[key_col].dataType.simpleString()
    out = documents.select(F.col(key_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(_id_batches(*names), f"key {kind}, ids array<int>")
    return out.select(F.col("key").alias(key_col), "ids")


def _counts(ranks_file: str, lexicon_file: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _encoder(ranks_file, lexicon_file)
        for batch in batches:
            for start, texts in _chunks(batch.column(0)):
                sizes = [sum(map(len, map(coder.known.__getitem__, words))) for words in coder.words(texts)]
                rest = [batch.column(i).slice(start, len(texts)) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), *rest], names=["n_tokens", *batch.schema.names[1:]])

    return run


def token_counts(documents: DataFrame, keep: list[str], text_col: str = "text", ranks_path: str | None = None) -> DataFrame:
    """``n_tokens`` of each row beside the columns ``keep``; null and empty texts have 0."""
    names = build_lexicon(documents, text_col, ranks_path)
    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(F.col(text_col).alias("__text"), *keep).mapInArrow(_counts(*names), f"n_tokens bigint, {fields}")
