"""Evaluation texts leaking into training text, found by winnowed fingerprints."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words per fingerprinted gram, and grams per window: every shared span of GRAM + WINDOW - 1 words is found.
GRAM, WINDOW = 5, 8
#: Fingerprints of test items in one broadcast block; more items make more blocks, never a larger one.
BLOCK_FINGERPRINTS = 500_000
#: Texts are worked on in pieces of about this many bytes.
PIECE_BYTES = 2_000_000

_DROP = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︀-️​-‍⁠﻿­]+")
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case without accents; đ is d, invisible characters are no break."""
    if not text:
        return []
    if not text.isascii():
        text = _DROP.sub("", unicodedata.normalize("NFD", text)).replace("đ", "d").replace("Đ", "D")
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """Word -> 64-bit hash, computed on first use; forgotten when there are too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return value


def fingerprints(hashes: np.ndarray, text_of: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams that are minimal in a window of their text.

    ``hashes`` are word hashes of many texts one after another, ``text_of`` the
    number of each word's text. Equal minima are all kept, which only adds grams.
    """
    span = gram + window - 1
    n = len(hashes) - span + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        grams = np.zeros(n + window - 1, np.uint64)
        for j in range(gram):
            grams = grams * _BASE + hashes[j : j + len(grams)]
        grams ^= grams >> np.uint64(31)
    low = grams[:n].copy()
    for j in range(1, window):
        np.minimum(low, grams[j : j + n], out=low)
    whole = text_of[:n] == text_of[span - 1 : span - 1 + n]
    low[~whole] = 0
    # a gram is chosen if it is the minimum of some whole window that holds it
    chosen = np.zeros(len(grams), bool)
    for j in range(window):
        chosen[j : j + n] |= whole & (grams[j : j + n] == low)
    at = np.flatnonzero(chosen)
    return at, grams[at]


def _flat(texts: list[str | None], hashes: _Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts, text number of each word, first word of each text (and the end)."""
    split = [words(t) for t in texts]
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.fromiter((hashes[w] for s in split for w in s), np.uint64, int(lengths.sum()))
    return flat, np.repeat(np.arange(len(split)), lengths), np.concatenate([[0], np.cumsum(lengths)])


def _extended(doc: np.ndarray, item: np.ndarray, i: int, j: int) -> tuple[int, int]:
    """Start in ``item`` and length of the longest common run through doc[i], item[j]."""
    back = 0
    while back < min(i, j) and doc[i - back - 1] == item[j - back - 1]:
        back += 1
    ahead = 0
    while ahead < min(len(doc) - i, len(item) - j) and doc[i + ahead] == item[j + ahead]:
        ahead += 1
    return j - back, back + ahead


def _blocks(items: DataFrame, block: int) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most ``block`` fingerprints, one at a time; one empty block where there is none."""
    one, room = [], 0
    for row in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").distinct().toLocalIterator():
        size = len(words(row.text))
        if room + size > block and one:
            yield one
            one, room = [], 0
        one.append((row.item_id, row.text))
        room += size
    yield one


def leaked_items(docs: DataFrame, items: DataFrame, gram: int = GRAM, window: int = WINDOW, block: int = BLOCK_FINGERPRINTS) -> DataFrame:
    """(doc_id, item_id, item_start, n_words): documents that hold a run of an item's words.

    ``docs``: doc_id, text; ``items``: item_id, text. A pair is given once, with its
    longest run, if that run has at least gram + window - 1 words; winnowing meets
    every such run, and the hit is extended word by word, so nothing is missed and
    nothing shorter is given. NULL, empty and short texts give no rows; repeated
    documents or items count once.

    The items are a stated query set: they are read in blocks of at most ``block``
    fingerprints, each broadcast and joined by binary search to the fingerprints of
    every document where it lies; the corpus is never shuffled nor collected.
    """
    shortest = gram + window - 1
    spark = docs.sparkSession
    corpus = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("item_start", pa.int32()), ("n_words", pa.int32())])
    found = None
    for one in _blocks(items, block):
        sent = spark.sparkContext.broadcast(one)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            hashes = _Hashes()
            ids, texts = [i for i, _ in sent.value], [t for _, t in sent.value]
            item_words, item_of, item_first = _flat(texts, hashes)
            item_at, item_grams = fingerprints(item_words, item_of, gram, window)
            order = np.argsort(item_grams, kind="stable")
            item_at, item_grams = item_at[order], item_grams[order]
            for doc_ids, doc_texts in _pieces(batches):
                flat, doc_of, first = _flat(doc_texts, hashes)
                at, grams = fingerprints(flat, doc_of, gram, window)
                lo, hi = np.searchsorted(item_grams, grams, "left"), np.searchsorted(item_grams, grams, "right")
                best: dict[tuple[int, int], tuple[int, int]] = {}
                reached: dict[tuple[int, int, int], int] = {}
                for h in np.flatnonzero(hi > lo):
                    d = int(doc_of[at[h]])
                    for k in range(lo[h], hi[h]):
                        m = int(item_of[item_at[k]])
                        shift = int(at[h] - first[d]) - int(item_at[k] - item_first[m])
                        i, j = int(at[h] - first[d]), int(item_at[k] - item_first[m])
                        if j < reached.get((d, m, shift), 0):
                            continue  # within a run that is known already
                        start, length = _extended(flat[first[d] : first[d + 1]], item_words[item_first[m] : item_first[m + 1]], i, j)
                        reached[d, m, shift] = start + length
                        if length >= shortest:
                            key = (doc_ids[d], ids[m])
                            best[key] = max(best.get(key, (0, 0)), (length, -start))
                rows = [(d, m, -s, n) for (d, m), (n, s) in best.items()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, schema, strict=True)], schema=schema)

        part = corpus.mapInArrow(run, "doc_id long, item_id long, item_start int, n_words int")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", (-F.col("item_start")).alias("s"))).alias("b")).select("doc_id", "item_id", (-F.col("b.s")).alias("item_start"), "b.n_words")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, ...]]:
    """Ids, texts and further columns of a batch in pieces of about PIECE_BYTES bytes of text."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1)
        sizes = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
        start = 0
        while start < len(ids):
            base = sizes[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(sizes, base + PIECE_BYTES, "right")))
            yield ids[start:end], *[c.slice(start, end - start).to_pylist() for c in (texts, *b.columns[2:])]
            start = end
