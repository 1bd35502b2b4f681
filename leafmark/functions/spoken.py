"""Spoken numbers and normal forms: what built-in functions lack, as Arrow-batched functions of a column."""

from __future__ import annotations

import html
import re
import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql.types import IntegerType, StringType

# Vietnamese number words and what they stand for.
UNITS = {"không": 0, "một": 1, "mốt": 1, "hai": 2, "ba": 3, "bốn": 4, "tư": 4, "năm": 5, "lăm": 5, "sáu": 6, "bảy": 7, "bẩy": 7, "tám": 8, "chín": 9}
SCALES = {"nghìn": 1_000, "ngàn": 1_000, "triệu": 1_000_000, "tỷ": 1_000_000_000, "tỉ": 1_000_000_000}
TEN, TENS, HUNDRED, POINT, HALF = "mười", "mươi", "trăm", "phẩy", "rưỡi"
FILLERS = {"linh", "lẻ"}

LARGE = {TEN, TENS, HUNDRED, *SCALES}
WORDS = {*UNITS, *LARGE, *FILLERS, POINT, HALF}
_ANY = "|".join(sorted(WORDS, key=len, reverse=True))
RUN = re.compile(rf"(?<!\w)(?:{_ANY})(?!\w)(?:\s+(?:{_ANY})(?!\w))*", re.I)
PERCENT = re.compile(r"\bphần\s+trăm\b", re.I)


def _phrase(words: list[str]) -> int:
    """How many of the words, from the first on, make one phrase.

    A unit after a unit begins another one, except among decimals; a half must follow a hundred or a scale.
    """
    for n in range(1, len(words)):
        word, before = words[n], words[n - 1]
        if (word in UNITS and before in UNITS and POINT not in words[:n]) or (word == HALF and before not in (HUNDRED, *SCALES)):
            return n
    return len(words) if words[0] != HALF else 0


# One letter a word, so that a phrase is read by a pattern: digit, ten, tens, hundred, scale, filler, half, point.
_KIND = dict.fromkeys(UNITS, "d") | dict.fromkeys(SCALES, "s") | dict.fromkeys(FILLERS, "f") | {TEN: "t", TENS: "T", HUNDRED: "h", HALF: "r", POINT: "p"}
_WEIGHT = {"h": 100, "T": 10, "": 1}
_GROUP = re.compile(r"(?P<below>[^s]*)(?P<scale>s?)(?P<half>r?)")
_PLACE = re.compile(r"(?P<said>[dft]*)(?P<place>[hT]?)(?P<half>r?)")


def _whole(words: list[str]) -> int | None:
    """The value of a phrase without decimals: groups parted by scales, in each the hundreds, tens and ones; None where it begins with a half.

    A place takes the last digit said since the place before. Without one a ten or a scale stands for itself, a hundred only where no digit came earlier.
    """
    kinds = "".join(_KIND[w] for w in words)

    def counted(at: re.Match) -> int:
        digit = next((UNITS[w] for w in reversed(words[slice(*at.span("said"))]) if w in UNITS), None)
        alone = {"h": "d" not in kinds[:at.start()], "T": 1, "": 0}[at["place"]]
        times = alone if digit is None or (at["place"] == "T" and not digit) else digit
        return _WEIGHT[at["place"]] * times + 10 * at["said"].count("t") + 50 * len(at["half"])

    def grouped(at: re.Match) -> int:
        below = sum(counted(place) for place in _PLACE.finditer(kinds, *at.span("below")))
        if not at["scale"]:
            return below
        scale = SCALES[words[at.start("scale")]]
        return (below or 1) * scale + (scale // 2) * len(at["half"])

    return None if kinds.startswith("r") else sum(map(grouped, _GROUP.finditer(kinds)))


def _value(words: list[str]) -> str | None:
    """A phrase in digits; None for a lone unit word and for what is no number."""
    if len(words) == 1 and words[0] not in LARGE:
        return None
    head, point, digits = "".join(_KIND[w] for w in words).partition("p")
    value = _whole(words[:len(head)])
    if value is None or not point:
        return None if value is None else str(value)
    return f"{value}.{''.join(str(UNITS[w]) for w in words[len(head) + 1:])}" if digits and set(digits) == {"d"} else None


def _in_digits(run: re.Match) -> str:
    parts = re.split(r"(\s+)", run[0])
    words, gaps = [p.lower() for p in parts[::2]], parts[1::2]
    out, at = [], 0
    while at < len(words):
        n = _phrase(words[at:])
        value = _value(words[at:at + n]) if n else None
        out.append(parts[2 * at] if value is None else value)
        at += 1 if value is None else n
        if at < len(words):
            out.append(gaps[at - 1])
    return "".join(out)


def spoken_to_digits(text: str) -> str:
    text = text if text.isascii() else PERCENT.sub("%", unicodedata.normalize("NFC", text))
    return re.sub(r"(\d)\s+%", r"\1%", RUN.sub(_in_digits, text))


@F.pandas_udf(StringType())
def _digits(texts: pd.Series) -> pd.Series:
    return texts.map(spoken_to_digits, na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFKC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(StringType())
def _unescaped(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: html.unescape(t) if "&" in t else t, na_action="ignore")


def digits_from_number_words(c: Column) -> Column:
    """Number phrases as digits and percent signs; a unit word by itself, an article more often than a number, stays."""
    return _digits(c)


def nfkc(c: Column) -> Column:
    return _nfkc(c)


def nfc(c: Column) -> Column:
    return _nfc(c)


def unescaped(c: Column) -> Column:
    """Character references of HTML as characters."""
    return _unescaped(c)


def _distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edits from one list of words, as numbers, to the other, a row of the table at a time; insertions by a running minimum."""
    steps = np.arange(len(b) + 1)
    row = steps.copy()
    for w in a:
        new = np.concatenate([[row[0] + 1], np.minimum(row[1:] + 1, row[:-1] + (b != w))])
        row = np.minimum.accumulate(new - steps) + steps
    return int(row[-1])


@F.arrow_udf(IntegerType())
def _word_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    """Equal words of a batch get one number, so that no word becomes an object."""
    code = pa.concat_arrays([a.flatten(), b.flatten()]).dictionary_encode(null_encoding="encode").indices.to_numpy()
    ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(a), 0).to_pylist(), *pc.fill_null(pc.list_value_length(b), 0).to_pylist()])
    row = lambda i: code[ends[i]:ends[i + 1]]
    known = pc.and_(a.is_valid(), b.is_valid()).to_pylist()
    return pa.array([_distance(row(i), row(len(a) + i)) if k else None for i, k in enumerate(known)], pa.int32())


def word_edits(a: Column, b: Column) -> Column:
    """Word-level edit distance of two arrays."""
    return _word_edits(a, b)
