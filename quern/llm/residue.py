"""Template residue, filler, error pages and scripts-required notices in fetched text.

A regularised linear classifier over hashed n-grams, length and title features
scores every sentence or line of a text. Its training labels are weak: the status of
the response and phrases vote, sentences in which the votes disagree are not used.
One host is kept out of training and serves to validate.
"""

from __future__ import annotations

import ast
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quern.session import checkpointed

#: Buckets of the hashed features.
BUCKETS = 1 << 14
#: Bound of the labelled sample: rows that are read for it, and sentences of each class that are kept.
SAMPLE_ROWS, SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 40_000, 12_000, 24_000
#: L2 penalty and the probability from which a sentence counts.
PENALTY, THRESHOLD = 0.00003, 0.5

# Keys of a payload that hold no fetched text.
NO_TEXT_KEYS = frozenset("final_url requested_url url http_status status mime_type content_type size_bytes lang type encoding sha256 raw_sha256 text_sha256".split())

# The spellings of unfilled placeholders.
PLACEHOLDER = re.compile(
    r"\{\{.*?\}\}|\{%.*?%\}|\$\{[^}\s]+\}|#\{[^}\s]+\}|<<\s*\w+\s*>>|<%.*?%>|\[\[\s*\w+\s*\]\]|%%\w+%%|%\(\w+\)[sd]|@@\w+@@|__[A-Z][A-Z_]+__|«\w+_\w+»|(?<!\w)\{\d\}"
    r"|<!--#.*?-->|@Model\.\w+|\[object Object\]|\[(?:INSERT|CHÈN)\b[^\]]*\]|(?<!\w)TODO\b|\[(?:Your|Tên|Nhập)\b[^\]]*\]"
)
# Beginnings of filler and of notices, and phrases inside them.
OPENING = re.compile(
    r"^(?:lorem ipsum|sed quis|đây là đoạn văn bản mẫu|tiêu đề bài viết|mô tả ngắn|đoạn văn bản giữ chỗ|nội dung đang được cập nhật|sample (?:paragraph|text)|replace this text"
    r"|(?:error|lỗi) ?\d{3}|\d{3} ?[–-] |http status \d|access denied|forbidden|bad gateway|server error|page not found|oops|rất tiếc|liên kết đã hết hiệu lực|hệ thống đang bảo trì|phiên làm việc đã hết"
    r"|bạn đã gửi quá nhiều|trang bạn yêu cầu|the page you|nothing was found|you do not have permission|object reference|type: exception|message: no handler|stack trace|internal server error"
    r"|javascript is|you need to enable|please (?:enable|turn)|this site requires|our viewer does|enable it to|checking your browser|vui lòng bật|xin hãy tắt|trình duyệt của bạn|nếu trang không tự|trang không thể hiển thị|đang tải"
    r"|vui lòng quay lại|quý khách vui lòng|mời đăng nhập lại|hãy thử lại sau|the upstream server|maybe try a search)",
    re.I,
)
LATIN_FILLER = re.compile(r"\b(?:lorem|ipsum|dolor|amet|consectetur|adipiscing|elit|aliqua|veniam|nostrud|ullamco|laboris)\b", re.I)
MENTION = re.compile(r"lorem ipsum|javascript|internal server error|không tìm thấy trang|báo lỗi|bảo trì|đăng nhập|trình duyệt|access denied|not found|máy chủ|error|giữ chỗ", re.I)

_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_DIGITS = re.compile(r"\d+")
_SIGNS = re.compile(r"[^\w\s.,;:!?()\"'/-]|__|\[")
_UPPER, _LOWER = re.compile(r"[A-ZĐÀ-ÝĂÂÊÔƠƯ](?:[^\W\d]*[^\W\d_])?"), re.compile(r"[a-zđà-ỹ](?:[^\W\d]*[^\W\d_])?")
_PLACEHOLDER_SIGN = re.compile(r"[{<%@_«\[]|TODO")
_LONG = 60
_BROKEN = re.compile(r"""["'](\w+)["']\s*:\s*(["'])(.*?)(?:(?<!\\)\2\s*[,}\]]|$)""", re.S)


def fetched_texts(payload: str | None) -> list[tuple[bool, str]]:
    """(is title, text) of every fetched text in a payload, at any nesting, also escaped JSON in a string.

    A payload that is no JSON is read as a Python literal, and what is cut off by its
    quoted fields. NULL and empty give nothing.
    """
    if not payload or not payload.strip():
        return []
    out: list[tuple[bool, str]] = []

    def parsed(text: str):
        for read in (json.loads, ast.literal_eval):
            try:
                return read(text)
            except (ValueError, SyntaxError, RecursionError, MemoryError):
                pass
        return None

    def walk(value, key: str, depth: int) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(v, str(k), depth + 1)
        elif isinstance(value, list):
            for v in value:
                walk(v, key, depth + 1)
        elif isinstance(value, str) and key not in NO_TEXT_KEYS and value.strip():
            if depth < 20 and value.lstrip()[:1] in "{[":
                inner = parsed(value)
                if isinstance(inner, (dict, list)):
                    walk(inner, key, depth + 1)
                    return
                if cut := _BROKEN.findall(value):
                    for k, _, text in cut:
                        try:
                            text = json.loads(f'"{text}"', strict=False)
                        except ValueError:
                            text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
                        walk(text, k, depth + 1)
                    return
            out.append((key == "title", value))

    walk(payload, "", 0)
    return out


def status_and_host(payload: str | None) -> tuple[int, str]:
    """Status (0: none) and host of a payload, by its plain fields; they weigh in the labels only."""
    status = re.search(r"""http_status["']\s*:\s*(\d+)""", payload or "")
    host = re.search(r"""final_url["']\s*:\s*["']https?://([^/"']+)""", payload or "")
    return int(status[1]) if status else 0, host[1].lower() if host else ""


def tokens(sentence: str) -> list[str]:
    """Words in lower case with digits as 0, and runs of signs."""
    return _TOKEN.findall(_DIGITS.sub("0", sentence.lower()))


def shapes(sentence: str) -> list[str]:
    """Signs of each piece between spaces, letters and digits of a run as one: {{a}}, %%A%%, ${a.a}."""
    if not _SIGNS.search(sentence):
        return []
    return ["<" + _UPPER.sub("A", _LOWER.sub("a", _DIGITS.sub("0", p))) + ">" for p in sentence.split() if _SIGNS.search(p)]


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass"))


class Features:
    """Buckets of the features of many sentences at once.

    A piece between spaces is cut into words and signs once; after that a sentence is
    a row of numbers, and its one- and two-grams are hashed in flat arrays. The
    buckets of two-grams follow from the hashes of both words.
    """

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.words, self.starts, self.signs = [], [], []
        self.flat = (np.empty(0, np.uint64), np.zeros(1, np.int64), np.empty(0, np.int64))

    def piece(self, raw: str) -> int:
        number = self.number[raw] = len(self.number)
        self.words += map(_hash, tokens(raw))
        self.starts.append(len(self.flat[0]) + len(self.words))
        shape = shapes(raw)
        self.signs.append(_hash(shape[0]) if shape else -1)
        return number

    def __call__(self, sentences: list[str], titles: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """(sentence, bucket) of all features, sorted, each pair once.

        Features are one- and two-grams of words and signs, shapes like {{a}} or
        %%A%%, the class of the length, and whether it is a title.
        """
        if len(self.number) > 300_000:
            self.clear()
        known, piece = self.number, self.piece
        split = [s.split() for s in sentences]
        flat = [known[p] if p in known else piece(p) for s in split for p in s]
        pieces = np.array(flat, np.int64)
        of = np.repeat(np.arange(len(split)), np.fromiter(map(len, split), np.int64, len(split)))
        if self.starts:
            # only what is new is turned into an array
            new = np.array(self.words, np.uint64), np.array(self.starts, np.int64), np.array(self.signs, np.int64)
            self.flat = tuple(np.concatenate(x) for x in zip(self.flat, new, strict=True))
            self.words, self.starts, self.signs = [], [], []
        words, starts, signs = self.flat
        n = (starts[1:] - starts[:-1])[pieces]
        ends = np.cumsum(n)
        token = words[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[:-1][pieces] - (ends - n), n)]
        owner = np.repeat(of, n)
        pair = owner[:-1] == owner[1:]
        two = (token[:-1] * np.uint64(0x9E3779B97F4A7C15) + token[1:] * np.uint64(0xC2B2AE3D27D4EB4F))[pair] >> np.uint64(40)
        signed = signs[pieces]
        shown = signed >= 0
        every = np.arange(len(split))
        length = np.array([_hash(f"<len {k}>") for k in range(7)], np.uint64)[np.minimum(np.bincount(owner, minlength=len(split)), 24) // 4]
        title = np.array([_hash("<title False>"), _hash("<title True>")], np.uint64)[np.array(titles, np.int64)]
        owners = np.concatenate([owner, owner[:-1][pair], of[shown], every, every])
        buckets = np.concatenate([token, two, signed[shown].astype(np.uint64), length, title]) & np.uint64(BUCKETS - 1)
        both = owners * BUCKETS + buckets.astype(np.int64)
        both.sort()
        both = both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both
        return both // BUCKETS, both % BUCKETS


def parts(text: str) -> list[str]:
    """Sentences and lines of a text, and in long ones the pieces with signs and two words beside; of what is over 4 * _LONG characters, windows of _LONG tokens."""
    out = []
    for s in _SENTENCE.split(text):
        if _SIGNS.search(s):
            t = s.split()
            out += [" ".join(t[max(0, i - 2) : i + 3]) for i, p in enumerate(t) if _SIGNS.search(p)] if len(t) > 6 else []
        if len(s) <= 4 * _LONG or len(at := [m.span() for m in _TOKEN.finditer(s)]) <= _LONG:
            if s.strip():
                out.append(s)
        else:
            out += [s[at[i][0] : at[min(i + _LONG, len(at)) - 1][1]] for i in range(0, len(at), _LONG // 2)]
    return out


def is_filler(sentence: str) -> bool:
    """Four words of the customary Latin, or ten words that are a few short ones over and over."""
    words = sentence.lower().split()
    return len(LATIN_FILLER.findall(sentence)) >= 4 or (len(words) >= 10 and len(set(words)) * 2 <= len(words) and max(map(len, words)) <= 5)


def weak_label(sentence: str, status: int) -> int | None:
    """1 residue, 0 text, None where the votes disagree.

    For residue: a placeholder, filler, a notice at the beginning. Against: a sentence
    without any phrase, or with one that a longer sentence only speaks of, both in an
    ordinary response. What stands beside the notice of an error response is not
    used; where an error response has no known phrase at all, the status decides and
    all its sentences count as residue (see ``_units``).
    """
    if (_PLACEHOLDER_SIGN.search(sentence) and PLACEHOLDER.search(sentence)) or OPENING.match(sentence.strip()) or is_filler(sentence):
        return 1
    if MENTION.search(sentence):
        return 0 if len(tokens(sentence)) >= 12 and status < 400 else None
    return None if status >= 400 else 0


def told(kind: str, body: str | None) -> Iterator[tuple[str, str, bool, int | None]]:
    """(host, sentence, is title, weak label) of every sentence of a row."""
    status, host = status_and_host(body) if kind == "evidence" else (0, "")
    found = [(s, is_title, weak_label(s, status)) for is_title, t in (fetched_texts(body) if kind == "evidence" else [(False, body or "")]) for s in parts(t)]
    unknown = status >= 400 and not any(label for _, _, label in found)
    for s, is_title, label in found:
        # an error response whose wording no phrase knows
        yield host, s, is_title, 1 if unknown and not is_title else label


def _units(rows: DataFrame) -> DataFrame:
    """Labelled sentences (host, label, indices of the features) of sampled rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featured = Features()
        for b in batches:
            host_of, label_of, kept, titles = [], [], [], []
            seen: set[tuple[str, int]] = set()
            for kind, text in zip(b.column("kind").to_pylist(), b.column("body").to_pylist(), strict=True):
                for host, s, is_title, label in told(kind, text):
                    if label is None or (s, label) in seen or (label == 0 and len(s) > 60 and _hash(s) % 8 and not MENTION.search(s)):
                        continue  # plain long sentences abound: an eighth of them is plenty
                    seen.add((s, label))
                    host_of.append(host)
                    label_of.append(float(label))
                    kept.append(s)
                    titles.append(is_title)
            owner, bucket = featured(kept, titles)
            offsets = np.searchsorted(owner, np.arange(len(kept) + 1)).astype(np.int32)
            index = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bucket, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(host_of, pa.string()), pa.array(label_of, pa.float64()), index, pa.array(list(map(_hash, kept)), pa.int64())], names=["host", "label", "index", "key"])

    return rows.mapInArrow(run, "host string, label double, index array<int>, key long")


def labelled(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The bounded labelled sample: host, label, index. ``rows``: kind, row_key, body."""
    n = rows.count()
    if n > sample_rows:
        rows = rows.where(F.pmod(F.xxhash64("kind", "row_key"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    units = checkpointed(_units(rows))
    kept = [units.where(F.col("label") == label).orderBy(F.xxhash64("key"), "key").limit(most) for label, most in ((1.0, SAMPLE_POSITIVE), (0.0, SAMPLE_NEGATIVE))]
    return checkpointed(kept[0].unionByName(kept[1]))


def held_out_host(units: DataFrame) -> str | None:
    """The host kept out of training: of at least two, the one whose hash is least."""
    hosts = units.where("host <> ''").groupBy("host").count().orderBy(F.xxhash64("host")).limit(2).collect()
    return hosts[0].host if len(hosts) > 1 else None


def fitted(units: DataFrame, without_host: str | None) -> tuple[np.ndarray, float] | None:
    """Weights and intercept; None where the sample lacks one of the classes."""
    train = units.where(F.lit(without_host).isNull() | (F.col("host") != F.lit(without_host)))
    if train.select("label").distinct().count() < 2:
        return None
    # a vector is written as its parts: their ones, dense, would be BUCKETS numbers a row
    model = LogisticRegression(regParam=PENALTY, maxIter=60, standardization=False, aggregationDepth=2).fit(_vectors(train).coalesce(4))
    return model.coefficients.toArray(), float(model.intercept)


def _vectors(units: DataFrame) -> DataFrame:
    """(label, features): the indices as sparse vectors with ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = b.column("index")
            values = pa.ListArray.from_arrays(index.offsets, pa.array(np.ones(len(index.values))))
            kind, size = pa.array(np.zeros(len(b), np.int8)), pa.array(np.full(len(b), BUCKETS, np.int32))
            vector = pa.StructArray.from_arrays([kind, size, index, values], names=["type", "size", "indices", "values"])
            yield pa.RecordBatch.from_arrays([b.column("label"), vector], names=["label", "features"])

    return units.select("label", "index").mapInArrow(run, StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())]))


#: Characters of sentences that are scored at once.
CHUNK = 2_000_000


def _scores(told_of: Iterator[tuple[object, str, bool]], model: tuple[np.ndarray, float], featured: Features) -> Iterator[tuple[list, np.ndarray]]:
    """(owners, scores) of sentences (owner, sentence, is title), in blocks of about CHUNK characters."""
    weights, intercept = model

    def block() -> tuple[list, np.ndarray]:
        owner, bucket = featured(sentences, titles)
        return owners, intercept + np.bincount(owner, weights[bucket], len(sentences))

    owners, sentences, titles, n = [], [], [], 0
    for of, s, is_title in told_of:
        owners.append(of)
        sentences.append(s)
        titles.append(is_title)
        n += len(s)
        if n > CHUNK:
            yield block()
            owners, sentences, titles, n = [], [], [], 0
    if sentences:
        yield block()


def residue_scores(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(kind, row_key, probability) of every row: its most suspicious sentence.

    ``rows``: kind (``evidence``: body is a payload, else body is the text), row_key,
    body. NULL, empty and blank bodies, and all rows where nothing could be learned,
    have probability 0; repeated rows give repeated rows. The model is the only thing
    that is broadcast and has a fixed size.
    """
    units = labelled(rows, sample_rows)
    model = fitted(units, held_out_host(units))
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featured = Features()
        for b in batches:
            best = np.full(len(b), -np.inf)
            if sent.value is not None:
                bodies = zip(b.column("kind").to_pylist(), b.column("body").to_pylist(), strict=True)
                all_told = ((i, s, is_title) for i, (kind, body) in enumerate(bodies) if body for is_title, t in (fetched_texts(body) if kind == "evidence" else [(False, body)]) for s in parts(t))
                for owners, scores in _scores(all_told, sent.value, featured):
                    np.maximum.at(best, np.array(owners), scores)
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("row_key"), pa.array(1 / (1 + np.exp(-np.clip(best, -700, 700))) * (best > -700))], names=["kind", "row_key", "probability"])

    return rows.select("kind", "row_key", "body").mapInArrow(run, "kind string, row_key string, probability double")


def validation(rows: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(host, held_out, label, n_sentences, n_flagged): weak labels against the model, per host.

    The model is fitted on the bounded sample without the held-out host; every sentence
    of all rows that has a label counts, as often as it occurs. Every batch sends
    one sum per host and label.
    """
    units = labelled(rows, sample_rows)
    host = held_out_host(units)
    sent = rows.sparkSession.sparkContext.broadcast(fitted(units, host))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        featured = Features()
        for b in batches:
            sentences, flagged = Counter(), Counter()
            bodies = zip(b.column("kind").to_pylist(), b.column("body").to_pylist(), strict=True)
            all_told = (((of, label), s, is_title) for kind, body in bodies for of, s, is_title, label in told(kind, body) if label is not None)
            for owners, scores in _scores(all_told, sent.value or (np.zeros(BUCKETS), -1.0), featured):
                sentences.update(owners)
                flagged.update(k for k, score in zip(owners, scores.tolist(), strict=True) if score >= 0)
            keys = list(sentences)
            columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([sentences[k] for k in keys], pa.int64()), pa.array([flagged[k] for k in keys], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "label", "n", "f"])

    sums = rows.select("kind", "body").mapInArrow(run, "host string, label int, n long, f long")
    grouped = sums.groupBy("host", "label").agg(F.sum("n").alias("n_sentences"), F.sum("f").alias("n_flagged"))
    return grouped.select("host", (F.col("host") == F.lit(host)).alias("held_out") if host else F.lit(False).alias("held_out"), "label", "n_sentences", "n_flagged")
