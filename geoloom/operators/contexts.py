"""Phrases in running text: where dictionary phrases occur, how they are written there, and what stands around them.

A text is cut into sentences at marks, a sentence into runs of letters and single other characters.  Words of an occurrence
are parted by exactly one other character.  A sentence's phrases are made where it lies and meet the dictionary in an
equi-join, so every occurrence is found, also inside longer ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.storage import at_most

MARKS = "[.!?,;:\\[\\]]"


def sentence_pieces(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc_id, sent, pieces, context): each sentence as runs of ASCII letters and single other characters, and the lower-case
    words of it, the one before and the one after.  Null and empty texts have none."""
    parts = F.filter(F.split(text, MARKS), lambda s: s.rlike("[A-Za-z]"))
    d = docs.select(F.col(id_col).alias("doc_id"), parts.alias("_s")).where(F.size("_s") > 0)
    d = d.withColumn("_w", F.transform("_s", lambda s: F.regexp_extract_all(F.lower(s), F.lit("[a-z]+"), F.lit(0))))
    none = F.array().cast("array<string>")
    around = F.transform("_w", lambda w, i: F.concat(w, F.when(i > 0, F.get("_w", i - 1)).otherwise(none), F.coalesce(F.get("_w", i + 1), none)))
    d = d.select("doc_id", F.posexplode(F.arrays_zip(F.col("_s").alias("s"), around.alias("c"))).alias("sent", "x"))
    return d.select("doc_id", "sent", F.regexp_extract_all("x.s", F.lit("[A-Za-z]+|[^A-Za-z]"), F.lit(0)).alias("pieces"), F.col("x.c").alias("context"))


def _occurrences(pieces: str, max_n: int, min_n: int = 1) -> Column:
    """Every run of words with one character between each two: (phrase, words, parts, before, after)."""
    p = F.col(pieces)

    def at(i: Column) -> Column:
        return F.get(p, i)

    def of(n: int) -> Column:
        def made(start: Column) -> Column:
            words = F.array(*(at(start + 2 * k) for k in range(n)))
            parts = F.array(*(at(start + 2 * k + 1) for k in range(n - 1))).cast("array<string>")
            return F.struct(
                F.lower(F.array_join(words, " ")).alias("phrase"), words.alias("words"), parts.alias("parts"),
                F.when(start > 0, at(start - 1)).alias("before"), at(start + 2 * n - 1).alias("after"),
            )

        starts = F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.forall(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(at(i + 2 * k).rlike("^[A-Za-z]"), F.lit(False))))
        return F.transform(starts, made)

    return F.concat(*(of(n) for n in range(min_n, max_n + 1)))


def occurrences(sentences: DataFrame, phrases: DataFrame, max_n: int = 6, broadcast_rows: int = 500_000) -> DataFrame:
    """(doc_id, sent, phrase, words, parts, before, after) of every occurrence of a phrase (phrase, lower case).

    The dictionary goes to the sentences while it has at most ``broadcast_rows`` entries (counted).
    """
    known = phrases.select("phrase").distinct()
    each = sentences.select("doc_id", "sent", F.explode(_occurrences("pieces", max_n)).alias("o")).select("doc_id", "sent", "o.*")
    return each.join(F.broadcast(known) if at_most(known, broadcast_rows) else known, "phrase")


def match_counts(sentences: DataFrame, phrases: DataFrame, max_n: int = 6) -> DataFrame:
    """(phrase, n): matches of every dictionary phrase; phrases that occur nowhere have no row."""
    return occurrences(sentences, phrases, max_n).groupBy("phrase").agg(F.count("*").alias("n"))


def punctuation_features(found: DataFrame) -> DataFrame:
    """(phrase, total, quote, dash, parenthesis, capital): of the occurrences of phrases of two words or more, the share in
    double quotes, with a dash inside, in brackets, with a capital on every word."""
    two = found.where(F.size("words") >= 2)
    flag = {
        "quote": (F.col("before") == '"') & (F.col("after") == '"'), "dash": F.array_contains("parts", "-"),
        "parenthesis": (F.col("before") == "(") & (F.col("after") == ")"), "capital": F.forall("words", lambda w: w.rlike("^[A-Z]")),
    }
    return two.groupBy("phrase").agg(F.count("*").alias("total"), *(F.avg(F.coalesce(c, F.lit(False)).cast("double")).alias(n) for n, c in flag.items()))


def outside_features(sentences: DataFrame, phrases: DataFrame, probabilities: DataFrame, idf: DataFrame, max_n: int = 6, broadcast_rows: int = 500_000) -> DataFrame:
    """(phrase, outside, new_outside) for phrases of two words or more: how often their words also stand around them.

    A word of an occurrence is outside if the sentence and its neighbours hold it more often than the sentence's occurrences
    of the phrase account for.  outside weighs the shares of such occurrences by the squared log probability of the word
    (``probabilities``: word, p), new_outside the mean surplus by its idf (``idf``: word, idf); a word without one counts 0.
    """
    known = phrases.select("phrase").where(F.size(F.split("phrase", " ")) >= 2).distinct()
    grams = F.transform(_occurrences("pieces", max_n, 2), lambda o: o["phrase"])
    s = sentences.select("context", grams.alias("_g")).where(F.size("_g") > 0)
    s = s.select("context", "_g", F.explode(F.array_distinct("_g")).alias("phrase")).join(F.broadcast(known) if at_most(known, broadcast_rows) else known, "phrase")
    s = s.withColumn("_c", F.size(F.filter("_g", lambda g: g == F.col("phrase")))).withColumn("_w", F.split("phrase", " "))
    s = s.select("phrase", "_c", "_w", "context", F.posexplode("_w").alias("i", "word"))
    inside = F.col("_c") * F.size(F.filter("_w", lambda w: w == F.col("word")))
    surplus = F.size(F.filter("context", lambda w: w == F.col("word"))) - inside
    per = s.groupBy("phrase", "i", "word").agg(F.sum(F.col("_c") * (surplus > 0).cast("int")).alias("f"), F.sum(F.col("_c") * F.greatest(surplus, F.lit(0))).alias("more"), F.sum("_c").alias("total"))
    per = per.join(probabilities.select("word", "p"), "word", "left").join(idf.select("word", "idf"), "word", "left")
    w2 = F.coalesce(F.pow(F.log("p"), 2), F.lit(0.0))
    i = F.coalesce("idf", F.lit(0.0))
    return per.groupBy("phrase").agg(
        F.sqrt(F.try_divide(F.sum(F.pow(F.col("f") / F.col("total"), 2) * w2), F.sum(w2))).alias("outside"), F.try_divide(F.sum(F.col("more") / F.col("total") * i), F.sum(i)).alias("new_outside")
    )
