"""Visually identical text with different characters.

A value is mapped to the letters it shows: invisible characters go, width and font variants and ligatures become plain
letters, look-alike letters of other scripts become one letter.  The mapped values are then grouped in SQL under the
accent-sensitive, case-sensitive Unicode collation (``UNICODE``), which makes composed and decomposed accents equal.  Every
class gets one canonical member, a known word if it holds one (the least of several), else its least value by code point,
and the class is joined back to its members.  Only distinct values are mapped and the result is written once, so the work
follows the vocabulary.

Look-alike letters come from the confusables of Unicode Technical Standard 39 as the session's own ICU library has them:
letters of one case with the same one-letter skeleton are one letter.  A few pairs that the standard lacks are fixed values.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.storage import cut

#: Letters that look the same as the letter after them, whatever the standard says.
LOOK_ALIKE = (
    # Cyrillic
    "аa еe оo рp сc уy хx іi јj ѕs һh ԁd ԛq ԝw ѵv ӏl АA ВB ЕE КK МM НH ОO РP СC ТT ХX УY ЅS ІI ЈJ ԌG ԚQ ԜW "
    # Greek
    "οo νv αa ιi ρp υu γy ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC "
    # Armenian
    "ոn սu օo հh ցg զq յj աw ՕO ՍU ՏS ԼL "
    # Latin
    "ɡg ɑa ıi ȷj ɩi"
)
BLANKS = "[\\u0009-\\u000d\\u0020\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u2800\\u3000\\u3164\\uffa0]+"
_SAME_LETTERS = {"<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>"}
_UNSEEN = {0x034F, 0x115F, 0x1160, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


@cache
def _table() -> dict[int, str]:
    """Code point to what it shows, from the character database: a few thousand entries made by rule."""
    out: dict[int, str] = {}

    def plain(c: str) -> str:
        tag, *parts = unicodedata.decomposition(c).split() or [""]
        return "".join(plain(chr(int(p, 16))) for p in parts) if tag in _SAME_LETTERS else c

    for code in range(sys.maxunicode + 1):
        c = chr(code)
        kind = unicodedata.category(c)
        if code in _UNSEEN or kind == "Cf" or (kind == "Cc" and code > 0x20):
            out[code] = ""
        elif kind[0] in "LMNPS" and (p := plain(c)) != c:
            out[code] = p
    return out


@cache
def _fixed() -> dict[int, str]:
    return {ord(pair[0]): pair[1] for pair in LOOK_ALIKE.split()}


_STANDARD: dict[int, str] = {}


def look_alikes(spark: SparkSession) -> dict[int, str]:
    """Code point to the letter it looks like: some thousand entries, whatever the data; made once a driver.

    Every class of letters with one skeleton has a member for each case: an ASCII letter if there is one, else the least
    code point.  Of one script only the first letter joins a class, as its letters are told apart by their readers (omicron
    looks like o, sigma does not).  ASCII letters, ideographs, Hangul and letters written from right to left stay as they are, and so do letters
    whose class has two ASCII letters of their case.  Where the session has no virtual machine of its own the fixed values do.
    """
    if not _STANDARD:
        _STANDARD.update(_fixed())
        jvm = getattr(spark, "_jvm", None)
        if jvm is None:
            return _STANDARD
        letters = [
            c for c in map(chr, range(sys.maxunicode + 1))
            if unicodedata.category(c)[0] == "L" and unicodedata.bidirectional(c) == "L" and not unicodedata.decomposition(c) and not unicodedata.name(c, "").startswith(("CJK", "HANGUL", "TANGUT", "NUSHU", "KHITAN"))
        ]
        skeleton = jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n")
        classes: dict[tuple[str, str], list[str]] = {}
        for c, form in zip(letters, skeleton):
            kind = unicodedata.category(c)
            if len(form) == 1 and unicodedata.category(form)[0] == "L":
                classes.setdefault((form, kind if kind in ("Lu", "Ll") else "Lo"), []).append(c)
        for (form, kind), alike in classes.items():
            # letters without case go with the ASCII letter of the skeleton itself
            plain = [c for c in alike if c.isascii()] or [c for c in (form,) if kind == "Lo" and c.isascii()]
            if len(plain) < 2:
                to = plain[0] if plain else min(alike)
                scripts = {unicodedata.name(to, "?").split()[0]}
                for c in sorted(alike):
                    if c != to and (script := unicodedata.name(c, "?").split()[0]) not in scripts:
                        scripts.add(script)
                        _STANDARD.setdefault(ord(c), _fixed().get(ord(to), to))
    return _STANDARD


def shown(value: str | None, alike: dict[int, str] | None = None) -> str | None:
    """The letters a value shows; null stays null, a value of invisible characters only becomes empty."""
    if value is None or value.isascii():
        return value
    plain = unicodedata.normalize("NFD", value.translate(_table())).translate(_fixed() if alike is None else alike)
    return unicodedata.normalize("NFC", plain)


def visual_words(text: str | Column) -> Column:
    """The words a reader sees: pieces between blanks of any kind."""
    return F.filter(F.split(F.regexp_replace(text, BLANKS, " "), " ", -1), lambda w: w != "")


def canonical_forms(values: DataFrame, known: DataFrame) -> DataFrame:
    """(value, canonical, word_id) for every distinct value of ``values`` (value) that shows something.

    ``known`` (word, word_id): the preferred forms.  word_id is null where the class holds no known word; if known words
    of one class differ, the least word wins, of one word with several ids the least id.  Null and empty values have no
    row; repeated values count once.
    """
    each = values.select("value", F.lit(None).cast("bigint").alias("word_id")).where("value <> ''").distinct()
    words = known.where("word <> ''").groupBy(F.col("word").alias("value")).agg(F.min("word_id").cast("bigint").alias("word_id"))
    both = each.withColumn("is_value", F.lit(True)).unionByName(words.withColumn("is_value", F.lit(False)))
    alike = look_alikes(values.sparkSession)

    @F.pandas_udf(T.StringType())
    def shown_text(given: pd.Series) -> pd.Series:
        return given.map(lambda v: shown(v, alike))

    # written once: what is read again below would otherwise be mapped again
    both, _ = cut(both.select("value", "word_id", "is_value", shown_text("value").alias("_shown")), "shown")
    both = both.where("_shown <> ''").withColumn("_class", F.collate("_shown", "UNICODE"))
    word = F.when(~F.col("is_value"), F.struct("value", "word_id"))
    classes = both.groupBy("_class").agg(F.min(word).alias("_word"), F.min("value").alias("_least"))
    named = classes.select("_class", F.coalesce("_word.value", "_least").alias("canonical"), F.col("_word.word_id").alias("word_id"))
    return both.where("is_value").select("value", "_class").join(named, "_class").select("value", "canonical", "word_id")
