"""Noise in text from scanned pages: broken words, misread characters, running headers, page numbers.

The corpus is its own dictionary. Words and pairs of words are counted over all
texts; a rare word that a symmetric-delete index puts beside a much more frequent
one is a suspect, a weighted edit distance with confusion pairs says how alike they
look, and the words beside each occurrence decide whether and how it is repaired.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.forms import plain
from quern.session import checkpointed

#: A correct word is this many times as frequent as its misreading.
RATIO = 20
#: Greatest weighted distance of a repair, and least count of its pairs of words.
FARTHEST, LEAST_CONTEXT = 1.0, 3
#: How much more frequent the repaired pair must be where a text begins with the suspect.
OPENING_RATIO = 60
#: Most frequent words that workers know by heart; all others are looked up by a join.
TRUSTED = 50_000

# Signs that a scan puts for others, and what they cost.
CONFUSED = {frozenset(p): 0.3 for p in ("hb", "o0", "l1", "i1", "i|", "l|", "e€", "y¥", "a@", "a§", "s5", "s$", "b8", "g9", "z2", "ce", "il", "í|", "nu", "uv", "l!", "i!", "o6")}
JOINED = {"rn": "m", "vv": "w", "cl": "d", "ii": "u", "li": "h"}
STRAY = "`'´^~*|"
DIGIT_LIKE = str.maketrans("oOlI|!zZsSgbBqD", "001111225598890")
SIGN_LETTER = str.maketrans("016|!€¥@§$5", "oloileyaass")

# Labels of a folio or an issue, and how page numbers are written.
LABEL = r"(?:trang|tr|pages?|pp?|pg|số|kỳ|tập|no|nr|vol|issue|ngày)"
FOLIO = re.compile(rf"(?:(?P<bar>\s*\|\s*)|(?P<wide>\s{{2,}})|\s*/\s*|(?:^|\s+)[—–-]\s*|(?P<comma>(?:^|,\s+)))(?P<label>{LABEL}\.?\s?)?\d[\d+/–-]*(?:\s\+(?:\s\d+)?)?(?:/{LABEL}\.?\s?\d[\d/-]*)?$", re.I)
LEADING = re.compile(r"^\d{1,4}(?:\s*\|\s*|\s{2,})(?=\S)")
PAGE = re.compile(r"^(?:[-–—~·•*]\s*\d{1,4}\s*[-–—~·•*]|\d{1,4}|(?:trang|page|p\.|tr\.)\s*\d{1,4}(?:\s*(?:/|of|trên)\s*\d{1,4})?|\[\s*(?:tr|p|trang|page)\.?\s*\d{1,4}\s*\]|\(\d{1,4}\)|\d+ \+ \d+)$", re.I)
HYPHENS = "-¬‐‑"
BREAK = re.compile(rf"(?<![\d/\-])(?<![^\W_])([^\W\d_]+)([{HYPHENS}])[ \t]*$")
_FIRST_WORD = re.compile(r"^\s*([^\W\d_]+)")
_LAST_WORD = re.compile(r"([^\W\d_]+),?$")
_DIGITS = re.compile(r"\d+")
_LETTERS = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(r"[^\s]+")
_EDGE = ".,;:()[]{}\"'’«»“”?!/…—–-"
_NUMBER_END = "0123456789+/–-—~·•*])"
_STOPS = re.compile(r"[.;:!?]\s")
#: A repeated line is a running header from so many interrupted sentences, and where they are at least this share of its occurrences.
LEAST_INTERRUPTED, INTERRUPTED_SHARE = 3, 0.5
#: Most words of a line by which it can be a title: a broken-off sentence has fewer capitals than words.
CAPITALS = 0.5


def title_like(line: str) -> bool:
    """Whether at least half of a line's words begin with a capital, the first one too, and no sentence ends in it."""
    if not line or line[-1] in ".;:," or line[0].islower() or _STOPS.search(line):
        return False
    found = _LETTERS.findall(line)
    return bool(found) and found[0][0].isupper() and sum(w[0].isupper() for w in found) >= CAPITALS * len(found)


def with_folio(line: str) -> bool:
    """Whether a line is a title beside a page or issue number: parted by a bar or wide space, or with a label.

    The number is looked for in the last 80 characters, the line may be of any length.
    A line that is a labelled number behind a mark or alone is what a line end left of one.
    """
    m = FOLIO.search(line, max(0, len(line) - 80))
    if m and (m["bar"] or m["wide"] or m["label"]):
        title = line[: m.start()].strip()
        if not title:
            return m["comma"] is None or bool(re.match("kỳ", m["label"] or "", re.I))
        if m["bar"] and m["label"]:
            return not _STOPS.search(title)
        return title_like(title)
    m = LEADING.match(line)
    return bool(m) and title_like(line[m.end() :])


def pieces(text: str, headers: frozenset[str] | set[str] = frozenset()) -> tuple[list[str], list[tuple[str, str]]]:
    """Lines of a text without noise, and the noise: (kind, what).

    Kinds: ``header``, ``page``, ``break`` (what: left-right of a word parted at a
    line end, over noise and blank lines). Broken words are joined with the mark in
    place, as left + U+0001 + mark + right, for a later decision. ``headers`` are the
    forms of lines that the corpus knows as running headers.
    """
    lines, noise = [], []
    for raw in text.replace("\r\n", "\n").split("\n"):
        line = raw.strip()
        if line and headers and form(line) in headers:
            noise.append(("header", line))
        # page numbers and folios stand at an end of their line
        elif not line or not (line[-1] in _NUMBER_END or line[0].isdigit()):
            lines.append(raw.rstrip())
        # a number behind a dash goes on with a range
        elif PAGE.match(line) and not (line.isdigit() and lines and re.search(r"[\s\d][-–]$", lines[-1])):
            noise.append(("page", line))
        elif with_folio(line):
            noise.append(("header", line))
        else:
            lines.append(raw.rstrip())
    out: list[str] = []
    last = None
    for line in lines:
        if line:
            if last is not None and out[last][-1] in HYPHENS:
                left = BREAK.search(out[last])
                right = _FIRST_WORD.match(line)
                if left and right and (right[1][0].islower() or out[last][left.start(1) :].isupper()):
                    noise.append(("break", f"{left[1]}-{right[1]}".lower() if left[2] != "¬" else ""))
                    del out[last + 1 :]
                    out[last] = out[last][: left.end(1)] + "\x01" + left[2] + line.lstrip()
                    continue
            last = len(out)
        out.append(line)
    return out, noise


def form(line: str) -> str:
    """What is the same in a line on every page: digits as 0, one space, small letters."""
    return _DIGITS.sub("0", " ".join(line.lower().split()))


def titles(lines: list[str]) -> list[tuple[str, str | None, str | None]]:
    """(form, word before, word behind) of every line that may be a running header.

    The words are those of a sentence that the line interrupts: the line before ends
    in a small word, the line behind begins with one. Else they are None.
    """
    kept = [x for x in map(str.strip, lines) if x]
    out = []
    for i, line in enumerate(kept):
        if title_like(line):
            before = _LAST_WORD.search(kept[i - 1]) if i else None
            behind = _FIRST_WORD.match(kept[i + 1]) if i + 1 < len(kept) else None
            cut = before and behind and before[1].islower() and behind[1][0].islower()
            out.append((form(line), before[1] if cut else None, behind[1].lower() if cut else None))
    return out


class _Clean(dict):
    """Raw token -> word in lower case without punctuation around it; forgotten when there are too many."""

    def __missing__(self, raw: str) -> str:
        if len(self) > 500_000:
            self.clear()
        t = raw.strip(_EDGE).lower()
        value = self[raw] = "0" if t and t[0].isdigit() and t.replace(".", "").replace(",", "").isdigit() else t
        return value


_clean = _Clean()


def tokens(text: str) -> list[str]:
    """Words in lower case without the punctuation around them; numbers are 0."""
    return [t for t in map(_clean.__getitem__, text.split()) if t]


def joined(lines: list[str]) -> str:
    """Lines as one string; the marks of broken words are dropped."""
    text = "\n".join(lines)
    return re.sub("\x01.", "", text) if "\x01" in text else text


@lru_cache(1 << 16)
def skeleton(word: str) -> str:
    """What is left of a word for the eye: no accents, signs as the letters they resemble."""
    bare = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c)).replace("đ", "d")
    for a, b in JOINED.items():
        if a in ("rn", "vv"):
            bare = bare.replace(a, b)
    return bare.translate(SIGN_LETTER)


_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def deletes(word: str) -> set[int]:
    """Hashes of the skeleton and of it with one character left out, in time that grows with the length.

    The hash is a polynomial, so what is left without a character follows from its
    beginning and end. Equal hashes of different strings only make one more candidate.
    """
    codes = [ord(c) for c in skeleton(word)]
    n = len(codes)
    ends, power = [0] * (n + 1), [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        ends[i] = (codes[i] * power[n - 1 - i] + ends[i + 1]) % _PRIME
        power[n - i] = power[n - 1 - i] * _BASE % _PRIME
    out, begin = {ends[0] ^ n}, 0
    for i in range(n):
        out.add((begin * power[n - 1 - i] + ends[i + 1]) % _PRIME ^ (n - 1))
        begin = (begin * _BASE + codes[i]) % _PRIME
    return out if n > 1 else {ends[0] ^ n} if n else set()


@lru_cache(1 << 16)
def _bare(c: str) -> str:
    return unicodedata.normalize("NFD", c)[0].replace("đ", "d")


@lru_cache(1 << 16)
def _swap(a: str, b: str) -> float:
    if a == b:
        return 0.0
    x, y = _bare(a), _bare(b)
    return 0.4 if x == y else CONFUSED.get(frozenset((x, y)), CONFUSED.get(frozenset((a, b)), 1.2))


def distance(seen: str, meant: str) -> float:
    """Weighted edit distance: accents, confusion pairs and stray signs are cheap, all else is dear.

    Exact up to FARTHEST, which no path more than three places off the diagonal can
    keep; beyond it any greater number.
    """
    n, m = len(seen), len(meant)
    far = 9e9
    band = 3
    rows: list[dict[int, float]] = []
    for i in range(n + 1):
        row: dict[int, float] = {}
        for j in range(max(0, i - band), min(m, i + band) + 1):
            if i == j == 0:
                row[j] = 0.0
                continue
            best = far
            if i:
                up = rows[i - 1]
                if j:
                    best = up.get(j - 1, far) + _swap(seen[i - 1], meant[j - 1])
                best = min(best, up.get(j, far) + (0.3 if seen[i - 1] in STRAY else 1.2))
                if i > 1 and j and JOINED.get(seen[i - 2 : i]) == _bare(meant[j - 1]):
                    best = min(best, rows[i - 2].get(j - 1, far) + 0.4)
            if j:
                best = min(best, row.get(j - 1, far) + 1.2)
            row[j] = best
        if i and min(row.values(), default=far) > FARTHEST and min(rows[-1].values(), default=far) > FARTHEST:
            return far
        rows.append(row)
    return rows[n].get(m, far)


def number_like(token: str) -> bool:
    """A number in which letters stand for digits, like 5O or 14.702.0o0."""
    return any(c.isdigit() for c in token) and not token.replace(".", "").replace(",", "").isdigit() and bool(re.fullmatch(r"\d{1,3}(?:[.,]\d{3})+|\d{1,4}", token.translate(DIGIT_LIKE)))


def counts(rows: DataFrame) -> DataFrame:
    """(word, pair, n): how often each word stands, and with word NULL each pair of words, by its hash.

    Every row counts as often as it occurs. Counts are summed per task before the
    shuffle; of a pair only its 64-bit hash is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single: Counter = Counter()
        double: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                words = tokens(joined(pieces(plain(text))[0]))
                single.update(words)
                double.update(zip(words, words[1:]))
            if len(single) + len(double) > 300_000:
                yield flush(single, double)
                single, double = Counter(), Counter()
        yield flush(single, double)

    def flush(single: Counter, double: Counter) -> pa.RecordBatch:
        first, second = [*single, *(a for a, _ in double)], [*[None] * len(single), *(b for _, b in double)]
        return pa.RecordBatch.from_arrays([pa.array(first, pa.string()), pa.array(second, pa.string()), pa.array([*single.values(), *double.values()], pa.int64())], names=["a", "b", "n"])

    told = rows.where("text IS NOT NULL").select("text").mapInArrow(run, "a string, b string, n long")
    return told.select(F.when(F.col("b").isNull(), F.col("a")).alias("word"), F.when(F.col("b").isNotNull(), F.xxhash64("a", "b")).alias("pair"), "n").groupBy("word", "pair").agg(F.sum("n").alias("n"))


def candidates(words: DataFrame) -> DataFrame:
    """(seen, meant, cost): a suspect and the frequent words it may stand for. ``words``: word, n.

    Both sides of the index are keyed by the hashes of ``deletes``; words of any
    length take part. A number with letters in it stands for itself in digits, which
    the confusion pairs give without an index.
    """
    typed = words.where("length(word) >= 2").select("word", "n")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, word, n = [], [], []
            for w, k in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                if any(c.isalpha() for c in w):
                    keys = deletes(w)
                    key += keys
                    word += [w] * len(keys)
                    n += [k] * len(keys)
                if len(key) > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["key", "word", "n"])
                    key, word, n = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(word, pa.string()), pa.array(n, pa.int64())], names=["key", "word", "n"])

    schema = "key long, word string, n long"
    # only words of letters that are RATIO times as frequent as something can be meant
    good = typed.where(F.col("word").rlike(r"^\p{L}+$") & (F.col("n") >= RATIO)).mapInArrow(index, schema).select("key", F.col("word").alias("meant"), F.col("n").alias("m"))
    rare = typed.mapInArrow(index, schema).select("key", F.col("word").alias("seen"), "n")
    pairs = rare.join(good, "key").where(F.col("m") >= RATIO * F.col("n")).select("seen", "meant").distinct()

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [distance(x, y) for x, y in zip(b.column("seen").to_pylist(), b.column("meant").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("seen"), b.column("meant"), pa.array(found, pa.float64())], names=["seen", "meant", "cost"])

    by_letters = pairs.mapInArrow(cost, "seen string, meant string, cost double").where(F.col("cost") <= FARTHEST)

    @F.udf("boolean", useArrow=True)
    def like_number(a):
        return number_like(a)

    numbers = typed.where(F.col("word").rlike("[0-9]") & F.col("word").rlike(r"\p{L}|\||!") & like_number("word")).select(F.col("word").alias("seen"), F.lit("0").alias("meant"), F.lit(0.3).alias("cost"))
    return checkpointed(by_letters.unionByName(numbers))


def occurrences(rows: DataFrame, trusted: list[str]) -> DataFrame:
    """(kind, row_key, what, at, before, token, after): noise of lines, lines that look like titles, and every word outside ``trusted``."""
    sent = rows.sparkSession.sparkContext.broadcast(frozenset(trusted))
    names = ["kind", "row_key", "what", "at", "before", "token", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for b in batches:
            out: list[tuple] = []
            for kind, key, text in zip(*(b.column(c).to_pylist() for c in ("kind", "row_key", "text")), strict=True):
                lines, noise = pieces(plain(text))
                out += [(kind, key, what, i, None, token, None) for i, (what, token) in enumerate(noise)]
                if len(lines) > 1:
                    out += [(kind, key, "title", i, before, token, after) for i, (token, before, after) in enumerate(titles(lines))]
                words = tokens(joined(lines))
                if not known.issuperset(words):
                    out += [(kind, key, "word", i, words[i - 1] if i else None, w, words[i + 1] if i + 1 < len(words) else None) for i, w in enumerate(words) if w not in known]
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if n == "at" else pa.string()) for n, c in zip(names, columns, strict=True)], names=names)

    return rows.where("row_key IS NOT NULL AND text IS NOT NULL").select("kind", "row_key", "text").mapInArrow(run, "kind string, row_key string, what string, at int, before string, token string, after string")


def running_headers(titled: DataFrame, pairs: DataFrame) -> DataFrame:
    """(token): forms of lines that interrupt sentences all over the corpus.

    ``titled``: token, before, after of title-like lines; ``pairs``: pair, n. A
    sentence is interrupted where the words before and behind the line are a pair that
    the corpus knows (at least LEAST_CONTEXT times). A heading stands between
    sentences and a name at a line's end has no known pair around it.
    """
    known = pairs.where(F.col("n") >= LEAST_CONTEXT).select(F.col("pair").alias("bridge"))
    per_form = titled.groupBy("token", F.when(F.col("before").isNotNull(), F.xxhash64("before", "after")).alias("bridge")).agg(F.count(F.lit(1)).alias("k"))
    # lines that interrupt nothing have no key to look up, so only the others meet the pairs
    cut = per_form.where("bridge IS NOT NULL").join(known, "bridge").groupBy("token").agg(F.sum("k").alias("cuts")).where(F.col("cuts") >= LEAST_INTERRUPTED)
    every = per_form.groupBy("token").agg(F.sum("k").alias("n"))
    return cut.join(every, "token").where(F.col("cuts") >= INTERRUPTED_SHARE * F.col("n")).select("token")


def repairs(rows: DataFrame) -> DataFrame:
    """(kind, row_key, what, at, token, meant): all noise of all texts.

    ``rows``: kind, row_key, text. ``what`` is header, page, break or word; for a
    word ``at`` is its number in the cleaned text and ``meant`` the repair (0 for a
    number). NULL and empty texts have none; of repeated rows the noise is named once,
    in the counts of the corpus they count as often as they occur. A title beside a
    page or issue number is a header by itself, any other line by what
    ``running_headers`` says (token: its form). A hyphen at a line end is no break
    where the hyphenated word is one of the corpus (at least LEAST_CONTEXT times
    within lines). The words that workers know by heart are a bounded list and only
    save lookups. No text is shuffled.
    """
    table = checkpointed(counts(rows))
    words = table.where("word IS NOT NULL").select("word", "n")
    pairs = table.where("pair IS NOT NULL").select("pair", "n")
    options = candidates(words)
    clean = words.join(options.select(F.col("seen").alias("word")).distinct(), "word", "left_anti")
    trusted = [r.word for r in clean.orderBy(F.desc("n"), "word").limit(TRUSTED).collect()]
    found = checkpointed(occurrences(rows, trusted))
    lines = found.where("what IN ('header', 'page')")
    titled = found.where("what = 'title'")
    headers = titled.join(running_headers(titled, pairs), "token", "left_semi").withColumn("what", F.lit("header"))
    compounds = words.where(F.col("word").contains("-") & (F.col("n") >= LEAST_CONTEXT)).select(F.col("word").alias("token"))
    breaks = found.where("what = 'break'").join(compounds, "token", "left_anti")
    place = ["kind", "row_key", "at", "token", "before", "after"]
    suspects = found.where("what = 'word'").join(options.withColumnRenamed("seen", "token"), "token").select(*place, "meant", "cost").distinct()
    # the four pairs around an occurrence are looked up in one join and become columns again
    slots = {"m1": ("before", "meant"), "m2": ("meant", "after"), "s1": ("before", "token"), "s2": ("token", "after")}
    around = F.array(*[F.struct(F.lit(k).alias("slot"), F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.xxhash64(a, b)).alias("pair")) for k, (a, b) in slots.items()])
    asked = suspects.select(*place, "meant", "cost", F.explode(F.filter(around, lambda x: x.pair.isNotNull())).alias("x")).select(*place, "meant", "cost", "x.slot", "x.pair")
    # what has no known pair around it has no support and may go
    contexts = asked.join(pairs, "pair").groupBy(*place, "meant", "cost").agg(*[F.max(F.when(F.col("slot") == k, F.col("n"))).alias(k) for k in slots])
    support = F.coalesce("m1", F.lit(0)) + F.coalesce("m2", F.lit(0))
    own = F.coalesce("s1", F.lit(0)) + F.coalesce("s2", F.lit(0))
    # a word of letters alone may be a rare but right one: both of its neighbours must speak for the repair
    both = (F.col("m1").isNotNull() | F.col("before").isNull()) & (F.col("m2").isNotNull() | F.col("after").isNull())
    # at the beginning of a text only one side can speak: it must do so far more clearly
    clear = F.col("before").isNotNull() | (support >= OPENING_RATIO * own)
    judged = contexts.withColumn("support", support).where((F.col("support") >= LEAST_CONTEXT) & (F.col("support") >= 4 * own) & (both & clear | ~F.col("token").rlike(r"^[\p{L}\-]+$")))
    best = F.min_by("meant", F.struct(-(F.log("support") - 3 * F.col("cost")), "meant")).alias("meant")
    chosen = judged.groupBy("kind", "row_key", "at", "token").agg(best).withColumn("what", F.lit("word"))
    fields = ["kind", "row_key", "what", "at", "token"]
    of_lines = lines.select(*fields).unionByName(headers.select(*fields)).unionByName(breaks.select(*fields)).distinct()
    return of_lines.unionByName(chosen.select(*fields, "meant"), allowMissingColumns=True)


def repaired(lines: list[str], words: dict[int, str], kept: set[str], headers: set[str] = frozenset()) -> str:
    """Continuous paragraphs of a text's lines from ``pieces``: broken words joined, words replaced.

    ``words``: number of a word -> repair; ``kept``: hyphenated words that are whole;
    ``headers``: forms of the lines that are running headers of the corpus.
    """

    def whole(lines: list[str]) -> str:
        return re.sub("([^\\W\\d_]+)\x01(.)([^\\W\\d_]+)", lambda m: m[1] + (m[2] if f"{m[1]}-{m[3]}".lower() in kept and m[2] != "¬" else "") + m[3], "\n".join(lines))

    marked = whole(lines)
    number, out, at = -1, [], 0
    for m in _TOKEN.finditer(marked) if words else ():
        inner = m.group().strip(_EDGE)
        if not inner:
            continue
        number += 1
        if number in words:
            start = m.start() + m.group().index(inner)
            meant = inner.translate(DIGIT_LIKE) if words[number] == "0" else words[number]
            meant = meant.upper() if inner.isupper() and len(inner) > 1 else meant[:1].upper() + meant[1:] if inner[:1].isupper() else meant
            out += [marked[at:start], meant]
            at = start + len(inner)
    out.append(marked[at:])
    paragraphs: list[str] = []
    # words are numbered with those of the headers, so these go last, and what they parted is joined
    shown = "".join(out)
    for line in (whole(pieces(shown, headers)[0]) if headers else shown).split("\n"):
        line = line.strip()
        if line and paragraphs and paragraphs[-1] and not paragraphs[-1].endswith((".", ":", ";", "!", "?")) and (line[0].islower() or line[0].isdigit() and not re.match(r"\d+[.)]\s", line)):
            paragraphs[-1] += " " + line
        else:
            paragraphs.append(line)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(paragraphs)).strip("\n")


def repaired_texts(rows: DataFrame) -> DataFrame:
    """(kind, row_key, text, n_repairs) of every distinct row; NULL stays NULL, empty stays empty."""
    noise = checkpointed(repairs(rows))
    per_row = noise.groupBy("kind", "row_key").agg(
        F.count(F.lit(1)).alias("n_repairs"),
        F.collect_list(F.when(F.col("what") == "word", F.struct("at", "meant"))).alias("words"),
        F.collect_set(F.when(F.col("what") == "break", F.col("token"))).alias("breaks"),
        F.collect_set(F.when(F.col("what") == "header", F.col("token"))).alias("headers"),
    )
    joined_rows = rows.select("kind", "row_key", "text").distinct().join(per_row, ["kind", "row_key"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for text, words, breaks, headers in zip(*(b.column(c).to_pylist() for c in ("text", "words", "breaks", "headers")), strict=True):
                if text is None:
                    texts.append(None)
                    continue
                lines, noise = pieces(plain(text))
                parted = {t for k, t in noise if k == "break"}
                texts.append(repaired(lines, {w["at"]: w["meant"] for w in words or []}, parted - set(breaks or []), {form(h) for h in headers or []}))
            n = [k or 0 for k in b.column("n_repairs").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("row_key"), pa.array(texts, pa.string()), pa.array(n, pa.int64())], names=["kind", "row_key", "text", "n_repairs"])

    return joined_rows.mapInArrow(run, "kind string, row_key string, text string, n_repairs long")
