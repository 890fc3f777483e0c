"""One consistent form for text that looks the same but differs in its characters.

A mapping from grapheme clusters to plain text is computed once by rule, checked
for conflicts, and applied by a compiled longest-match scanner in one pass: widths,
decomposed accents, spaces, invisible characters and look-alike letters together.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters that look like a Latin letter, and that letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТУХҮаеѕіјорсухһԛԝ", "ABESIJKMHOPCTYXYaesijopcyxhqw", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϲϳ", "ABEZHIKMNOPTYXovcj", strict=True))
#: Greek small letters that stand for themselves when alone (coefficients) and for a Latin one only inside a Latin word.
GREEK_INSIDE = dict(zip("αικρυχ", "aikpux", strict=True))
LATIN = dict(zip("ÐƉðɖıɑɡ", "ĐĐđđiag", strict=True))
ARMENIAN = dict(zip("օհոսցՕՏԼ", "ohnugOSL", strict=True))
INVISIBLE = "​‌‍⁠﻿­"
MARKS = "̀-ͯ᪰-᫿᷀-᷿⃐-⃿"

LOOKALIKE = {**CYRILLIC, **GREEK, **LATIN, **ARMENIAN}


def _spaces() -> list[str]:
    """Spaces within a line other than the plain one; line and paragraph separators are none."""
    return ["\t", "\x0b", "\x0c", *(chr(c) for c in range(0x80, 0x3001) if unicodedata.category(chr(c)) == "Zs")]


def _widths() -> dict[str, str]:
    """Full-width and half-width forms, and letters of mathematical alphabets, with the ordinary characters they stand for."""
    table = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0xFF01, 0xFFEF) if unicodedata.east_asian_width(chr(c)) in "FH" and chr(c) not in "\uff9e\uff9f\uffa0"}
    for c in list(table):
        for mark in "\uff9e\uff9f":
            voiced = unicodedata.normalize("NFKC", c + mark)
            if len(voiced) == 1:
                table[c + mark] = voiced
    fonts = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(0x1D400, 0x1D800)}
    return table | {c: plain for c, plain in fonts.items() if plain.isascii() and plain != c}


def _accents() -> dict[str, str]:
    """Every spelling of a precomposed letter by base and marks, in any order of the marks, of all alphabets."""
    table: dict[str, str] = {}
    for c in range(0xC0, 0x3000):
        letter = chr(c)
        parts = unicodedata.normalize("NFD", letter)
        if len(parts) == 1 or unicodedata.normalize("NFC", letter) != letter or not all(map(unicodedata.combining, parts[1:])):
            continue
        base, marks = parts[0], parts[1:]
        for order in {marks, marks[::-1]}:
            if unicodedata.normalize("NFC", base + order) == letter:
                table[base + order] = letter
                half = unicodedata.normalize("NFC", base + order[0])
                if len(order) == 2 and len(half) == 1:
                    table[half + order[1]] = letter
    return table


def _on(bases: dict[str, str], accents: dict[str, str]) -> dict[str, str]:
    """The accents on characters that stand for their base."""
    by_base: dict[str, list[str]] = {}
    for cluster in accents:
        by_base.setdefault(cluster[0], []).append(cluster)
    return {c + cluster[1:]: accents[cluster] for c, base in bases.items() for cluster in by_base.get(base, ())}


def _merged(*tables: dict[str, str]) -> dict[str, str]:
    """One table of several; ValueError where a cluster has two images or an image would be rewritten itself."""
    out: dict[str, str] = {}
    for part in tables:
        for key, value in part.items():
            if out.setdefault(key, value) != value:
                raise ValueError(f"two images of {key!r}: {out[key]!r}, {value!r}")
    for key, value in out.items():
        if value in out:
            raise ValueError(f"unstable image of {key!r}: {value!r}")
    return out


@lru_cache(1)
def mapping() -> dict[str, str]:
    """Cluster -> plain text wherever it stands: widths, spaces, invisible characters and accents, also on each other."""
    accents, widths = _accents(), _widths()
    return _merged(widths, dict.fromkeys(_spaces(), " "), dict.fromkeys(INVISIBLE, ""), accents, _on({k: v for k, v in widths.items() if len(k) == 1}, accents))


@lru_cache(1)
def word_mapping() -> dict[str, str]:
    """Cluster -> plain text within a Latin word: ``mapping`` and look-alikes, with accents too, checked as one table.

    What is a letter of another alphabet elsewhere (with its own accents) is Latin here.
    """
    alike = LOOKALIKE | GREEK_INSIDE
    accents = _accents()
    latin = {k: v for k, v in mapping().items() if k[0] not in alike and not (set(v) & set(alike))}
    return _merged(latin, alike, _on(alike, accents))


#: Letters of mathematical alphabets. A character class that held them one by one would be searched one by one.
_FONTS = re.compile("[\U0001d400-\U0001d7ff]")


def _char_class(chars) -> str:
    return "".join(re.escape(c) for c in sorted(chars) if c < "\U00010000")


@lru_cache(1)
def _scanner() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Screen for anything to rewrite; words (letters, marks, invisibles); clusters, longest first."""
    singles = _char_class({k for k in mapping() if len(k) == 1})
    alike = _char_class({*LOOKALIKE, *GREEK_INSIDE})
    screen = re.compile(f"[{singles}{alike}{MARKS}]")
    word = re.compile(f"(?:[^\\W\\d_]|[{MARKS}{_char_class(INVISIBLE)}])+")
    cluster = re.compile(f"\\w[{MARKS}]+|[\uff66-\uff9d][\uff9e\uff9f]|[{singles}{alike}]|{_FONTS.pattern}")
    return screen, word, cluster


@lru_cache(1 << 14)
def _script(letter: str) -> str:
    """LATIN, ALIKE (may stand for a Latin letter) or OTHER."""
    if letter in LOOKALIKE or letter in GREEK_INSIDE:
        return "LATIN" if letter in LATIN else "ALIKE"
    name = unicodedata.name(letter, "")
    return "LATIN" if name.startswith(("LATIN", "FULLWIDTH LATIN")) or mapping().get(letter, "").isascii() and mapping().get(letter, "").isalpha() else "OTHER" if unicodedata.category(letter)[0] == "L" else ""


@lru_cache(1 << 16)
def _scripts(word: str) -> frozenset[str]:
    return frozenset(map(_script, word)) - {""}


def _latin_words(text: str, words: list[re.Match]) -> list[bool]:
    """Which words are Latin words, so that look-alikes in them stand for Latin letters.

    A word with a letter that has no Latin look-alike belongs to its own script. A
    word with a Latin letter is Latin. A word of look-alikes only is Latin unless a
    word beside it is of another script, or it is one small Greek letter.
    """
    kinds = [_scripts(w.group()) for w in words]
    own = []
    for w, k in zip(words, kinds, strict=True):
        if "OTHER" in k:
            own.append(False)
        elif "LATIN" in k or not k:
            own.append(True)
        else:
            letters = [c for c in w.group() if _script(c)]
            own.append(None if all(c in LOOKALIKE for c in letters) and not (len(letters) == 1 and letters[0] in "ονϲϳ") else False)
    for i, known in enumerate(own):
        if known is None:
            beside = [j for j in (i - 1, i + 1) if 0 <= j < len(words)]
            own[i] = not any("OTHER" in kinds[j] for j in beside)
    return own


def plain(text: str | None) -> str | None:
    """The plain form of ``text``; NULL stays NULL, text without anything to rewrite stays itself."""
    screen, word, cluster = _scanner()
    if text is None or not (screen.search(text) or _FONTS.search(text)):
        return text
    words = list(word.finditer(text))
    latin = _latin_words(text, words)

    def rewrite(table: dict[str, str]):
        def one(m: re.Match) -> str:
            c = m.group()
            known = table.get(c)
            if known is not None or len(c) == 1:
                return c if known is None else known
            # marks that no letter has with them: the longest beginning that is known, then the rest as it is
            for n in range(len(c) - 1, 0, -1):
                if c[:n] in table:
                    return unicodedata.normalize("NFC", table[c[:n]] + c[n:])
            return unicodedata.normalize("NFC", c)

        return one

    out, at = [], 0
    inner, outer = rewrite(word_mapping()), rewrite(mapping())
    for w, is_latin in zip(words, latin, strict=True):
        out.append(cluster.sub(outer, text[at : w.start()]))
        # invisible characters would part a letter from its marks, so they go first
        letters = w.group().translate(_NOTHING) if any(c in INVISIBLE for c in w.group()) else w.group()
        out.append(cluster.sub(inner if is_latin else outer, letters))
        at = w.end()
    out.append(cluster.sub(outer, text[at:]))
    return "".join(out)


_NOTHING = dict.fromkeys(map(ord, INVISIBLE))


def plain_values(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field, row_key, value, plain): one row per row of ``rows`` and field.

    NULL gives NULL, empty gives empty. Rows are worked on where they lie, nothing
    is shuffled; repeated rows give repeated rows, other columns are not read.
    """
    schema = pa.schema([("field", pa.string()), ("row_key", pa.string()), ("value", pa.string()), ("plain", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in fields:
                values = b.column(f).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(values), pa.string()), b.column("row_key"), pa.array(values, pa.string()), pa.array([plain(v) for v in values], pa.string())], schema=schema
                )

    return rows.select(F.col(key).cast("string").alias("row_key"), *fields).mapInArrow(run, "field string, row_key string, value string, plain string")
