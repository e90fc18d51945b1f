"""Tokenisers and normalisers.  Null text gives null."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_words(text: str | Column, min_length: int = 2, stopwords: list[str] = ()) -> Column:
    """Runs of ASCII letters and digits, lower case, at least ``min_length`` long and no stopwords."""
    w = F.transform(F.regexp_extract_all(text, F.lit("[0-9a-zA-Z]+"), F.lit(0)), lambda x: F.lower(x))
    return F.filter(w, lambda x: (F.length(x) >= min_length) & (~x.isin(*stopwords) if stopwords else F.lit(True)))


def filter_by_tag(tokens: str | Column, tags: list[str]) -> Column:
    """Tokens (struct with a field tag) whose tag is in the set."""
    return F.filter(tokens, lambda t: t["tag"].isin(*tags))


def split_sentences(text: str | Column) -> Column:
    """Lower case, cut at sentence marks and brackets, other non-letters to single blanks, apostrophes kept."""
    parts = F.split(F.lower(text), '[.!?,;:()"\\[\\]]')
    clean = F.transform(parts, lambda s: F.trim(F.regexp_replace(s, "[^a-z']+", " ")))
    return F.filter(clean, lambda s: s != "")


def split_sentences_kept(text: str | Column) -> Column:
    """Cut at sentence marks, case and quotes kept; empty parts dropped."""
    return F.filter(F.split(text, "[.!?,;:'\\[\\]]"), lambda s: F.trim(s) != "")


def split_by(text: str | Column, mark: str) -> Column:
    """Pieces between marks, empty ones dropped."""
    return F.filter(F.split(text, f"\\Q{mark}\\E"), lambda s: s != "")


def normalize_phrase(text: str | Column) -> Column:
    """Lower case; everything but letters a-z becomes one blank."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z]+", " "))


def normalize_text(text: str | Column) -> Column:
    """Lower case, one form of quotes, punctuation set apart, digits to blanks."""
    t = F.regexp_replace(F.lower(text), "[’′]", "'")
    t = F.regexp_replace(F.regexp_replace(t, "''", " "), "[“”]", '"')
    t = F.regexp_replace(t, "([\"'.,()!?;:])", " $1 ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[0-9]", " "), "\\s+", " "))


def strip_markup(text: str | Column) -> Column:
    """Wiki markup to plain text: references, tags, links, templates and entities go."""
    t = F.regexp_replace(text, "(?s)<ref[^>/]*>.*?</ref>", "")
    for pattern, into in (
        ("<[^>]*>", ""), ("\\[http[^\\]\\s]*\\s?([^\\]]*)\\]", "$1"), ("\\[\\[(?:image|file|category)[^\\]]*\\]\\]", ""),
        ("\\[\\[[^|\\]]*\\|", "[["), ("\\{\\{[^}]*\\}\\}", ""), ("\\{[^}]*\\}", ""), ("\\[|\\]", ""), ("&[^;\\s]*;", " "),
    ):
        t = F.regexp_replace(t, "(?i)" + pattern, into)
    return t


def clean_line(text: str | Column) -> Column:
    """Line breaks to blanks, as a tagger that reads a post a line needs."""
    return F.regexp_replace(text, "[\\r\\n]+", " ")


def phrase_tokens(text: str | Column) -> Column:
    """Letters and apostrophes make tokens; what stands in (nested) brackets is skipped; sentence marks give '$'."""

    @F.pandas_udf("array<string>")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(one)

    def one(line):
        if line is None:
            return None
        out, word, depth = [], [], 0
        for c in line.lower() + "\n":
            letter = "a" <= c <= "z" or c == "'"
            if letter and not depth:
                word.append(c)
            elif c == "(":
                depth += 1
            elif c == ")":
                depth = max(0, depth - 1)
            elif not letter or depth:
                if word and not depth:
                    out.append("".join(word))
                    word = []
                if c in '.!?,;:"[]':
                    if word:
                        out.append("".join(word))
                        word = []
                    out.append("$")
        return out

    return run(text)


def bracket_offsets(text: str | Column) -> Column:
    """Array of (begin, end) of bracketed phrases, counted in the text without its brackets."""

    @F.pandas_udf("array<struct<begin:int,end:int>>")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(one)

    def one(line):
        if line is None:
            return None
        out, at, begin = [], 0, None
        for c in line:
            if c == "[":
                begin = at
            elif c == "]":
                if begin is not None:
                    out.append({"begin": begin, "end": at})
                begin = None
            else:
                at += 1
        return out

    return run(text)
