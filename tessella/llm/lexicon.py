"""A minimal acyclic transducer from words to token ids, in one memory-mapped file.

Words share prefixes and suffixes. Each arc carries the number of words that
come before those reached through it, so the sum along a word is its rank in
byte order, and the rank leads to its ids. Walking is vectorised: all words of
a batch take one step at a time.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"LEX1"
#: Longer words are never in a lexicon; they go to the merges.
MAX_BYTES = 32


class _Builder:
    """Incremental minimisation over words in byte order."""

    def __init__(self):
        self.arcs: list[dict[int, int]] = [{}]
        self.final = [False]
        self.register: dict[tuple, int] = {}
        self.path: list[tuple[int, int, int]] = []  # parent, byte, child not yet minimised
        self.last = b""

    def add(self, word: bytes) -> None:
        common = 0
        for a, b in zip(word, self.last):
            if a != b:
                break
            common += 1
        self._minimise(common)
        state = self.path[-1][2] if self.path else 0
        for byte in word[common:]:
            child = len(self.arcs)
            self.arcs.append({})
            self.final.append(False)
            self.arcs[state][byte] = child
            self.path.append((state, byte, child))
            state = child
        self.final[state] = True
        self.last = word

    def _minimise(self, keep: int) -> None:
        while len(self.path) > keep:
            parent, byte, child = self.path.pop()
            signature = (self.final[child], tuple(sorted(self.arcs[child].items())))
            known = self.register.setdefault(signature, child)
            if known != child:
                self.arcs[parent][byte] = known
                self.arcs[child] = {}

    def finish(self) -> None:
        self._minimise(0)


def build(words: dict[bytes, list[int]]) -> bytes:
    """The file's bytes. Empty words and words over MAX_BYTES are left out."""
    order = sorted(w for w in words if 0 < len(w) <= MAX_BYTES)
    made = _Builder()
    for word in order:
        made.add(word)
    made.finish()
    number = {0: 0}
    queue = [0]
    for state in queue:
        for child in made.arcs[state].values():
            if child not in number:
                number[child] = len(number)
                queue.append(child)
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        state = stack[-1]
        todo = [c for c in made.arcs[state].values() if c not in below]
        if todo:
            stack.extend(todo)
            continue
        below[state] = made.final[state] + sum(below[c] for c in made.arcs[state].values())
        stack.pop()
    keys, targets, outs = [], [], []
    for state in queue:
        before = int(made.final[state])
        for byte, child in sorted(made.arcs[state].items()):
            keys.append(number[state] << 8 | byte)
            targets.append(number[child])
            outs.append(before)
            before += below[child]
    final = [made.final[s] for s in queue]
    ids = [words[w] for w in order]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    parts = [
        np.array(keys, "<i8"),
        np.array(targets, "<i4"),
        np.array(outs, "<i4"),
        np.array(final, "<i4"),
        starts.astype("<i4"),
        np.array([i for x in ids for i in x], "<i4"),
    ]
    return MAGIC + struct.pack("<6i", *map(len, parts)) + b"\0" * 4 + b"".join(p.tobytes() for p in parts)


class Lexicon:
    """The file, mapped; pages are shared by the processes of a machine."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            if f.read(4) != MAGIC:
                raise ValueError(f"{path} is no lexicon")
            sizes = struct.unpack("<6i", f.read(24))
        at, parts = 32, []
        for n, kind in zip(sizes, ("<i8", "<i4", "<i4", "<i4", "<i4", "<i4")):
            parts.append(np.memmap(path, kind, "r", at, (n,)) if n else np.empty(0, kind))
            at += n * np.dtype(kind).itemsize
        self.keys, self.targets, self.outs, self.final, self.starts, self.ids = parts

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 if it isn't there."""
        n = len(words)
        if not n or not len(self.keys):
            return np.full(n, -1)
        size = np.fromiter(map(len, words), np.int64, n)
        fits = (size > 0) & (size <= MAX_BYTES)
        padded = np.frombuffer(b"".join(w[:MAX_BYTES].ljust(MAX_BYTES, b"\0") for w in words), np.uint8).reshape(n, MAX_BYTES)
        state = np.zeros(n, np.int64)
        rank = np.zeros(n, np.int64)
        for j in range(int(size[fits].max()) if fits.any() else 0):
            at = np.flatnonzero(fits & (size > j))
            key = state[at] << 8 | padded[at, j]
            place = np.searchsorted(self.keys, key)
            place[place == len(self.keys)] = 0
            hit = self.keys[place] == key
            fits[at[~hit]] = False
            at, place = at[hit], place[hit]
            rank[at] += self.outs[place]
            state[at] = self.targets[place]
        fits &= self.final[state] == 1
        return np.where(fits, rank, -1)

    def ids_of(self, rank: int) -> list[int]:
        return self.ids[self.starts[rank] : self.starts[rank + 1]].tolist()
