"""Keyword-stuffed and link-list pages as outliers of robust text statistics."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.forms import INVISIBLE
from quern.llm.leaks import _pieces
from quern.session import checkpointed

# Frequent function words of each language.
FUNCTION_WORDS = {
    "vi": "và của có được không các cho trong là với khi một những để do theo tại từ này đã thì hoặc phải về bị nếu trước sau bằng ra vào người mà cũng như nhưng đến ở chỉ cần hai lại mỗi kể đó nào".split(),
    "en": "the of and to in a is that for on with as by at from be are or an it this not may shall must which has was have no more than when where each any their its after before".split(),
    "fr": "le la les de des du et en un une est pour que qui dans par sur au aux avec ne pas ce se sa son ses ou il elle sont plus cette leur tout chaque avant après sans sauf d l".split(),
}
#: Languages that are told apart; ``other`` is any without a word list.
LANGUAGES = (*FUNCTION_WORDS, "other")
#: Share of function words below which a language given beside the text counts more than the words.
LEAST_SHARE = 0.1
#: Statistics of a text, with the sign of the direction in which spam lies.
FEATURES = {"function_share": -1, "entropy": -1, "repetition": 1, "collision": 1, "links": 1, "separators": 1, "prose": -1}
#: Quantile of the chi-square distribution that the squared distance must pass, by Wilson-Hilferty.
NORMAL_QUANTILE = 12.0
#: Least texts of a language by which it has a centre and scale of its own.
LEAST_TEXTS = 100
#: Re-estimations of centre and scatter from the texts that lie within the 97.5 % ellipsoid.
ROUNDS = 2
#: A text of so many words shows half of its deviation squared: the statistics of few words scatter widely.
HALF_WORDS = 20

_WORD = re.compile(r"\w+")
_LINK = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|#\w+|</?a\b[^>]*>")
_VIETNAMESE, _FRENCH, _LATIN = re.compile("[ăđơưẠ-ỹ]", re.I), re.compile("[éèêëàâçùûîïôœ]", re.I), re.compile("[a-z]", re.I)
_CUT = re.compile(r"[.,;:!?|•\n]+(?=\s|$)|\n|\|")


def chi_square(quantile: float, dims: int) -> float:
    """Chi-square value at a normal quantile (Wilson-Hilferty)."""
    return dims * (1 - 2 / (9 * dims) + quantile * (2 / (9 * dims)) ** 0.5) ** 3


class _Words(dict):
    """Word -> number, in order of first use."""

    def __missing__(self, word: str) -> int:
        value = self[word] = len(self)
        return value


def told_language(text: str, given: str | None) -> str:
    """Language of a text that function words do not tell: Vietnamese letters, what is given, accents, letters."""
    given = (given or "").strip().lower()[:3]
    if _VIETNAMESE.search(text):
        return "vi"
    if given not in ("", "und"):
        return given if given in FUNCTION_WORDS else "other"
    return "fr" if _FRENCH.search(text) else "en" if _LATIN.search(text) else "other"


def statistics(texts: list[str], given: list[str | None] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, language number, FEATURES of each text) of many texts at once.

    Logarithms and roots make the statistics comparable between short and long texts.
    The language is that of most function words, and where there are few of them what
    letters and ``given`` tell; the share of function words counts those of all
    languages, as texts may be mixed.
    """
    docs = len(texts)
    numbers = _Words()
    links = np.zeros(docs)
    cuts = np.zeros(docs)
    prose = np.zeros(docs)
    split = []
    for i, text in enumerate(texts):
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            for sign in INVISIBLE:
                if sign in text:
                    text = text.replace(sign, "")
        if "#" in text or "://" in text or "<a" in text or "www." in text:
            text, links[i] = _LINK.subn(" ", text)
        parts = _CUT.split(text)
        found = [_WORD.findall(p) for p in map(str.lower, parts)]
        cuts[i] = len(parts)
        prose[i] = sum(n for n in map(len, found) if n >= 6)
        split.append([w for f in found for w in f])
    lengths = np.fromiter(map(len, split), np.int64, docs)
    flat = np.fromiter((numbers[w] for s in split for w in s), np.int64, int(lengths.sum()))
    doc = np.repeat(np.arange(docs), lengths)
    n = np.maximum(lengths, 1)
    kinds = np.zeros((len(FUNCTION_WORDS), len(numbers) + 1))
    for k, words in enumerate(FUNCTION_WORDS.values()):
        kinds[k, [numbers[w] for w in words if w in numbers]] = 1
    shares = np.stack([np.bincount(doc, kinds[k, flat], docs) for k in range(len(FUNCTION_WORDS))]) / n
    language, most = shares.argmax(0), shares.max(0)
    for i in np.flatnonzero(most < LEAST_SHARE):
        told = told_language(texts[i], given[i] if given else None)
        language[i] = LANGUAGES.index(told) if most[i] == 0 or told == "other" else language[i]
    function = np.bincount(doc, kinds.max(0)[flat], docs) / n

    width = len(numbers) + 1

    def counted(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, sum of c log c and sum of c (c - 1) of each owner."""
        order = np.sort(owner * (width * width) + key) if docs * width * width < 2**62 else None
        if order is None:
            pairs = np.lexsort((key, owner))
            same = (np.diff(owner[pairs]) == 0) & (np.diff(key[pairs]) == 0)
            owners = owner[pairs]
        else:
            same = np.diff(order) == 0
            owners = order // (width * width)
        start = np.flatnonzero(np.concatenate([[True], ~same])) if len(owners) else np.empty(0, np.int64)
        c = np.diff(np.concatenate([start, [len(owners)]]))
        o = owners[start] if len(start) else np.empty(0, np.int64)
        return np.bincount(o, minlength=docs), np.bincount(o, c * np.log(np.maximum(c, 1)), docs), np.bincount(o, c * (c - 1.0), docs)

    _, clogc, _ = counted(flat, doc)
    entropy = (np.log(n) - clogc / n) / np.log(n + 1)
    pair = doc[:-1] == doc[1:]
    distinct, _, equal = counted(flat[:-1][pair] * width + flat[1:][pair], doc[:-1][pair])
    pairs = np.maximum(lengths - 1, 1)
    values = np.stack(
        [
            np.sqrt(function),
            entropy,
            1 - distinct / pairs,
            np.log1p(200 * equal / np.maximum(pairs * (pairs - 1.0), 1)),
            np.sqrt(links / (n + links)),
            np.log((cuts + links) / (n + links)),
            prose / n,
        ],
        axis=1,
    )
    return lengths + links.astype(np.int64), language, values


def text_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, language, FEATURES...) of every text that is not NULL; blank ones have 0 words.

    A column ``lang``, where there is one, tells the language of texts without function words.
    """
    names = ["doc_id", "n_words", "language", *FEATURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, given in _pieces(batches):
            words, language, values = statistics(texts, given)
            columns = [pa.array(ids, pa.int64()), pa.array(words, pa.int64()), pa.array([LANGUAGES[k] for k in language], pa.string()), *[pa.array(v) for v in values.T]]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string").alias("lang"))
    return rows.mapInArrow(run, "doc_id long, n_words long, language string, " + ", ".join(f"{f} double" for f in FEATURES))


def _each(rows: DataFrame, usual: Column, *aggregates: Column) -> dict[str, dict]:
    """``aggregates`` by language and, under "", over all rows: one row per language reaches the driver.

    A language of fewer than LEAST_TEXTS ``usual`` rows is left out, so that it is
    measured against all texts: a few pages, all of them spam perhaps, are no measure.
    """
    got = [r.asDict() for r in rows.rollup("language").agg(F.count_if(usual).alias("n"), *aggregates).collect()]
    return {r["language"] or "": r for r in got if not r["language"] or r["n"] >= LEAST_TEXTS}


def _by_language(values: dict[str, float]) -> Column:
    """The number of each row's language, that of all texts for one without."""
    out = F.lit(values.get("")).cast("double")
    for k, v in values.items():
        if k:
            out = F.when(F.col("language") == k, F.lit(float(v))).otherwise(out)
    return out


def _scaled(stats: DataFrame) -> DataFrame:
    """FEATURES as (value - median) / scale within the language; scale from the median deviation.

    Texts without any function word make no language of their own. A statistic that is the same for half of the texts would have scale 0; it gets a floor, the
    tenth of its 1-99 % range, or 0.02. Deviations of short texts are reduced by
    HALF_WORDS.
    """
    usual = (F.col("function_share") > 0) | (F.col("language") == "other")
    med = _each(stats, usual, *[F.percentile_approx(f, [0.5, 0.01, 0.99], 2000).alias(f) for f in FEATURES])
    centre = {f: {k: r[f][0] for k, r in med.items() if r[f]} for f in FEATURES}
    mad = _each(stats, usual, *[F.percentile_approx(F.abs(F.col(f) - _by_language(centre[f])), 0.5, 2000).alias(f) for f in FEATURES])
    scale = {f: {k: max(1.4826 * mad[k][f], 0.1 * (r[f][2] - r[f][1]), 0.02) for k, r in med.items() if r[f]} for f in FEATURES}
    weight = F.col("n_words") / F.hypot(F.col("n_words"), F.lit(HALF_WORDS))
    return stats.select("doc_id", "n_words", "language", *[(weight * (F.col(f) - _by_language(centre[f])) / _by_language(scale[f])).alias(f) for f in FEATURES])


def _moments(rows: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Centre and scatter of each language: one aggregate of a few sums, whatever the rows."""
    names = list(FEATURES)
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    out = {}
    for k, r in _each(rows, F.lit(True), *[F.avg(f).alias(f) for f in names], *[F.avg(F.col(names[i]) * F.col(names[j])).alias(f"c{i}_{j}") for i, j in pairs]).items():
        if not r["n"]:
            continue
        centre = np.array([r[f] for f in names])
        scatter = np.zeros((len(names),) * 2)
        for i, j in pairs:
            scatter[i, j] = scatter[j, i] = r[f"c{i}_{j}"] - centre[i] * centre[j]
        out[k] = (centre, scatter + np.eye(len(names)) * 0.05)
    return out


def _distance(moments: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple[Column, Column]:
    """Squared Mahalanobis distance, and how far the deviation lies in the spam direction (its cosine)."""
    names, signs = list(FEATURES), np.array(list(FEATURES.values()))
    roots = {k: np.linalg.cholesky(np.linalg.inv(s)).T for k, (_, s) in moments.items()}
    centred = [F.col(f) - _by_language({k: c[i] for k, (c, _) in moments.items()}) for i, f in enumerate(names)]
    white = [sum((_by_language({k: w[i, j] for k, w in roots.items()}) * centred[j] for j in range(i, len(names))), F.lit(0.0)) for i in range(len(names))]
    square = sum((w * w for w in white), F.lit(0.0))
    toward = sum((F.lit(float(s)) * c for s, c in zip(signs, centred, strict=True)), F.lit(0.0))
    length = F.sqrt(sum((c * c for c in centred), F.lit(1e-9)))
    return square, toward / (length * float(np.sqrt(len(names))))


def spam_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, language, n_words, distance2, toward): robust distance of every text and its direction.

    Statistics are scaled by median and median deviation per language; centre and
    scatter start from texts within three scales in every statistic and are
    re-estimated from those inside the 97.5 % ellipsoid. Only sums per language
    reach the driver. NULL texts give no row; texts without a word have NULL scores
    and repeated rows repeated scores.
    """
    stats = checkpointed(text_statistics(docs))
    scaled = checkpointed(_scaled(stats.where("n_words > 0")))
    inlier = F.lit(True)
    for f in FEATURES:
        inlier = inlier & (F.abs(F.col(f)) <= 3)
    moments = _moments(scaled.where(inlier))
    for _ in range(rounds):
        square, _ = _distance(moments)
        moments |= _moments(scaled.where(square <= chi_square(1.96, len(FEATURES))))
    square, toward = _distance(moments)
    scored = scaled.select("doc_id", "language", "n_words", square.alias("distance2"), toward.alias("toward"))
    return scored.unionByName(stats.where("n_words = 0").select("doc_id", "language", "n_words"), allowMissingColumns=True)


#: Cosine with the spam direction from which an outlier counts as spam.
TOWARD = 0.25


def spam(docs: DataFrame) -> DataFrame:
    """doc_id of keyword-stuffed, link-list and tag pages: far outliers that lie toward spam."""
    limit = chi_square(NORMAL_QUANTILE, len(FEATURES))
    return spam_scores(docs).where((F.col("distance2") > limit) & (F.col("toward") > TOWARD)).select("doc_id").distinct()
