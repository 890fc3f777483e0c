"""Encoding of whole corpora with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text encoded at once in a task, and distinct words a task remembers.
PIECE_BYTES, REMEMBERED = 1_000_000, 400_000
#: Words of more bytes are merged with a heap, one at a time.
LONG_WORD = 512
_NONE = np.iinfo(np.int64).max


class Vocabulary:
    """Ranks of a vocabulary file as sorted pair keys: left id * size + right id -> merged id."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        self.split = regex.compile(pattern).findall
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        get = ranks.get
        pairs = [
            (left * self.size + right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := get(token[:cut])) is not None and (right := get(token[cut:])) is not None
        ]
        keys, merged = np.array(pairs, np.int64).T
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], merged[order]
        self.known: dict[str, int] = {}
        self._clear()

    def _clear(self) -> None:
        self.known.clear()
        self.ids, self.starts, self.counts = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id of each pair, or a number beyond all ids."""
        wanted = left * self.size + right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.merged[at], _NONE)

    def _heap_merge(self, symbols: np.ndarray) -> np.ndarray:
        """One long word: lowest rank first, of equal ranks the leftmost."""
        ids, n = symbols.tolist(), len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        one = lambda a, b: int(self._ranks(np.array([a]), np.array([b]))[0])
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(self._ranks(symbols[:-1], symbols[1:])) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for p in (before[i], i):
                if p >= 0 and after[p] < n and (r := one(ids[p], ids[after[p]])) != _NONE:
                    heapq.heappush(heap, (r, p, ids[p], ids[after[p]]))
        return np.array([x for x, a in zip(ids, alive, strict=True) if a], np.int64)

    def _merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many words one after another, and the number of ids of each.

        The symbols of all words lie in one flat array. Each round looks up all
        neighbouring pairs by binary search, takes in every word the leftmost pair
        of lowest rank, and joins it; words without a pair leave the array.
        """
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        done: list[np.ndarray] = [np.empty(0, np.int64)] * len(raw)
        for w in np.flatnonzero(lengths > LONG_WORD):
            done[w] = self._heap_merge(self.byte_ids[np.frombuffer(raw[w], np.uint8)])
        short = np.flatnonzero(lengths <= LONG_WORD)
        symbols = self.byte_ids[np.frombuffer(b"".join([raw[w] for w in short]), np.uint8)]
        word = np.repeat(short, lengths[short])
        finished_words, finished_symbols = [], []
        while len(symbols):
            rank = np.full(len(symbols), _NONE)
            inside = word[:-1] == word[1:]
            rank[:-1][inside] = self._ranks(symbols[:-1][inside], symbols[1:][inside])
            first = np.flatnonzero(np.concatenate([[True], ~inside]))
            low = np.minimum.reduceat(rank, first)
            span = np.diff(np.concatenate([first, [len(symbols)]]))
            lows = np.repeat(low, span)
            active = lows != _NONE
            if not active.all():
                finished_words.append(word[~active])
                finished_symbols.append(symbols[~active])
            hit = np.flatnonzero(active & (rank == lows))
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])] if len(hit) else hit
            symbols[hit] = rank[hit]
            active[hit + 1] = False
            symbols, word = symbols[active], word[active]
        for w in np.flatnonzero(lengths > LONG_WORD):
            finished_words.append(np.full(len(done[w]), w))
            finished_symbols.append(done[w])
        if not finished_words:
            return np.empty(0, np.int32), np.zeros(len(raw), np.int64)
        words, ids = np.concatenate(finished_words), np.concatenate(finished_symbols)
        order = np.argsort(words, kind="stable")
        return ids[order].astype(np.int32), np.bincount(words, minlength=len(raw))

    def _learn(self, new: list[str]) -> None:
        ids, counts = self._merge([w.encode("utf-8", "surrogatepass") for w in new])
        starts = len(self.ids) + np.concatenate([[0], np.cumsum(counts)[:-1]])
        first = len(self.known)
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.ids, self.starts, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.starts, starts]).astype(np.int64), np.concatenate([self.counts, counts]).astype(np.int64)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin (with the end)."""
        split = [self.split(t) if t else [] for t in texts]
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        flat = [w for s in split for w in s]
        if len(self.known) > REMEMBERED:
            self._clear()
        if new := list(dict.fromkeys(w for w in set(flat) if w not in self.known)):
            self._learn(new)
        code = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        counts = self.counts[code]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(self.starts[code] - (ends - counts), counts) + np.arange(total)]
        word_ends = np.concatenate([[0], ends])
        return ids, word_ends[np.concatenate([[0], np.cumsum(lengths)])]


_OPEN: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of ``path``, read once in a worker."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = Vocabulary(path, pattern)
    return _OPEN[path, pattern]


def encoded(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens.

    NULL and empty texts have the empty list. Strings of special tokens in a text
    are ordinary text. One row per input row, also for repeated ones; other columns
    are not read. Rows are encoded where they lie: no shuffle, and a word that was
    met before costs one lookup.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path, pattern)
        for b in batches:
            sizes = np.cumsum(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < b.num_rows:
                base = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, base + PIECE_BYTES, "right")))
                ids, offsets = known.encode(b.column(1).slice(start, end - start).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), lists], names=[key, "ids"])
                start = end

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"{key} long, ids array<int>")
