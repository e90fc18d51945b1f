"""Text layouts of everything between posts and models: bins, queries, candidates, graphs, vectors, phrases.

Writers give one column ``value`` of lines, to be saved as text; parsers take such lines and give typed columns.  Parsers that
need the place of a line take a column ``line_no`` as well (from 0).  A field that is no number becomes null; blank lines are
left out.  Everything stays in the JVM and is split by line like any text file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = (
    "candidate_id bigint, query_id int, query_bin_list array<int>, "
    "members array<struct<tweet_id: bigint, user_id: bigint, lat: double, lng: double, created_time: string, timestamp: bigint, message: string>>"
)
FEATURES = ["spatial_unusualness", "temporal_unusualness", "st_unusualness", "lat_std", "lng_std", "time_std", "semantic_std", "spatial_burstiness"]


def _text(lines: DataFrame) -> DataFrame:
    return lines.where(F.trim("value") != "")


def _field(i: int, sep: str, kind: str | None = None) -> Column:
    f = F.get(F.split("value", sep, -1), F.lit(i))
    return f if kind is None else f.try_cast(kind)


def location(value: str | Column) -> Column:
    """'lat,lng' as struct<lat, lng>; null if either is no number."""
    parts = F.split(value, ",", -1)
    lat, lng = (F.trim(F.get(parts, F.lit(i))).try_cast("double") for i in (0, 1))
    return F.when(lat.isNotNull() & lng.isNotNull() & (F.size(parts) == 2), F.struct(lat.alias("lat"), lng.alias("lng")))


def literal_list(value: str | Column) -> Column:
    """array<double> of a list in text, '[1, 2.5]'; null if it is none."""
    return F.from_json(value, "array<double>")


def list_text(vector: str | Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(vector, lambda x: x.cast("double").cast("string")), ", "), F.lit("]"))


# posts and bins


def membership_lines(scored: DataFrame) -> DataFrame:
    """Rows with scores (array) and cluster_id: the scores, then the cluster, separated by commas."""
    return scored.select(F.concat_ws(",", F.array_join(F.transform("scores", lambda x: x.cast("string")), ","), F.col("cluster_id").cast("string")).alias("value"))


def parse_membership(lines: DataFrame) -> DataFrame:
    """(line_no, cluster_id): the last field of every line."""
    return _text(lines).select("line_no", F.element_at(F.split("value", ","), -1).try_cast("int").alias("cluster_id"))


def window_lines(rows: DataFrame, places: bool = True) -> DataFrame:
    """vec and, if wanted, the two scaled coordinates (lat, lng), separated by blanks."""
    numbers = F.transform("vec", lambda x: x.cast("double").cast("string"))
    return rows.select(F.concat_ws(" ", numbers, *([F.col("lat").cast("string"), F.col("lng").cast("string")] if places else [])).alias("value"))


def parse_window(lines: DataFrame, dim: int, places: bool = True) -> DataFrame:
    """(vec[, lat, lng]): the first ``dim`` numbers of a line and the two behind them; lines with fewer numbers are left out."""
    n = F.transform(F.split(F.trim("value"), "\\s+"), lambda x: x.try_cast("double"))
    rows = _text(lines).withColumn("_n", n).where(F.size("_n") >= dim + (2 if places else 0))
    return rows.select(F.slice("_n", 1, dim).alias("vec"), *([F.get("_n", F.lit(dim)).alias("lat"), F.get("_n", F.lit(dim + 1)).alias("lng")] if places else []))


def manifest_lines(manifest: DataFrame, dim: int) -> DataFrame:
    """(line_no, value): the number of the last bin, which is not counted, then the vector length, then 'bin count' rows."""
    last = manifest.agg(F.max("bin_id").alias("last")).select(F.lit(0).cast("bigint").alias("line_no"), (F.coalesce("last", F.lit(-1)) + 1).cast("string").alias("value"))
    length = manifest.sparkSession.createDataFrame([(1, str(dim))], "line_no bigint, value string")
    return last.unionByName(length).unionByName(manifest.select((F.col("bin_id") + 2).alias("line_no"), F.concat_ws(" ", "bin_id", "n").alias("value")))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """(bin_id, n) from manifest lines."""
    return lines.where("line_no >= 2").select(_field(0, " ", "bigint").alias("bin_id"), _field(1, " ", "bigint").alias("n"))


def query_text(windows: DataFrame) -> DataFrame:
    """(value): the bins of every window, separated by blanks, ordered by the first bin."""
    return windows.orderBy("start_bin").select(F.array_join(F.transform("bins", lambda b: b.cast("string")), " ").alias("value"))


def bins_of_queries(binned: DataFrame, queries: DataFrame, broadcast_rows: int = 200_000) -> DataFrame:
    """Every post of every bin of every query: the posts' columns, query_id and nth, the bin's place in the query from 0.

    ``queries`` (query_id, bins): queries may overlap, so a post comes once for each.  The list of bins goes to the posts
    while it has at most ``broadcast_rows`` entries (counted), else both are shuffled by bin.
    """
    from geoloom.storage import at_most

    q = queries.select("query_id", F.posexplode("bins").alias("nth", "bin_id")).withColumn("bin_id", F.col("bin_id").cast("bigint"))
    return binned.join(F.broadcast(q) if at_most(q, broadcast_rows) else q, "bin_id")


def with_clusters(posts: DataFrame, clusters: DataFrame) -> DataFrame:
    """Posts of queries with the cluster of their row (query_id, tid, cluster_id); posts without one are left out."""
    return posts.join(clusters.select("query_id", "tid", "cluster_id"), ["query_id", "tid"])


# candidates


def candidate_lines(candidates: DataFrame) -> DataFrame:
    """One JSON object a candidate."""
    return candidates.select(F.to_json(F.struct("candidate_id", "query_id", "query_bin_list", "members")).alias("value"))


def parse_candidates(lines: DataFrame) -> DataFrame:
    return _text(lines).select(F.from_json("value", CANDIDATE).alias("c")).select("c.*")


def feature_lines(features: DataFrame) -> DataFrame:
    """candidate_id and the eight features, tab-separated; a missing number is an empty field."""
    return features.select(F.array_join(F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ["candidate_id", *FEATURES])), "\t").alias("value"))


def parse_features(lines: DataFrame) -> DataFrame:
    return _text(lines).select(_field(0, "\t", "bigint").alias("candidate_id"), *(_field(i + 1, "\t", "double").alias(c) for i, c in enumerate(FEATURES)))


def description_lines(top: DataFrame, messages: DataFrame) -> DataFrame:
    """One JSON object a candidate (candidate_id, size, posts) from (candidate_id, tid, rank) and (candidate_id, tid, message)."""
    size = messages.groupBy("candidate_id").agg(F.count("*").alias("size"))
    said = top.join(messages.select("candidate_id", "tid", "message"), ["candidate_id", "tid"]).groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "message"))), lambda s: s["message"]).alias("posts"))
    return said.join(size, "candidate_id").select(F.to_json(F.struct("candidate_id", "size", "posts")).alias("value"))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """(candidate_id, size, posts) from a file that holds one JSON array, or one object a line."""
    return spark.read.schema("candidate_id bigint, size bigint, posts array<string>").json(path, multiLine=True)


def parse_labels(lines: DataFrame) -> DataFrame:
    """(candidate_id, label) from tab-separated lines; one that is no number gives a null label."""
    return _text(lines).select(_field(0, "\t", "bigint").alias("candidate_id"), _field(1, "\t", "int").alias("label"))


def true_events(labels: DataFrame) -> DataFrame:
    """(candidate_id): those labelled 1."""
    return labels.where(F.col("label") == 1).select("candidate_id").distinct()


def metric_lines(metrics: DataFrame) -> DataFrame:
    """method, precision, recall, f1, tab-separated, four digits."""
    return metrics.select(F.concat_ws("\t", "method", *(F.format_string("%.4f", F.col(c)) for c in ("precision", "recall", "f1"))).alias("value"))


# graph and vectors


def edge_lines(edges: DataFrame) -> DataFrame:
    """u, v, weight and type, tab-separated."""
    return edges.select(F.concat_ws("\t", "u", "v", F.col("weight").cast("string"), "etype").alias("value"))


def parse_edges(lines: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(etype, u, v, weight); with ``nodes`` (node), edges with an unknown end are left out."""
    from geoloom.operators.graph import known_edges

    e = _text(lines).select(_field(3, "\t").alias("etype"), _field(0, "\t").alias("u"), _field(1, "\t").alias("v"), _field(2, "\t", "double").alias("weight"))
    return e if nodes is None else known_edges(e, nodes)


def vector_lines(vectors: DataFrame, key: str, vec: str) -> DataFrame:
    """key and the numbers, separated by blanks; blanks in the key become '_'."""
    return vectors.select(F.concat_ws(" ", F.regexp_replace(F.col(key).cast("string"), "\\s", "_"), F.transform(vec, lambda x: x.cast("string"))).alias("value"))


def parse_vectors(lines: DataFrame, dim: int) -> DataFrame:
    """(node, vec array<float>) of the lines with ``dim`` numbers; a heading line has fewer."""
    parts = F.split(F.trim("value"), " ")
    return _text(lines).where(F.size(parts) == dim + 1).select(parts[0].alias("node"), F.transform(F.slice(parts, 2, dim), lambda x: x.try_cast("float")).alias("vec"))


def named_by_place(vectors: DataFrame, centres: DataFrame, prefix: str, value: list[str]) -> DataFrame:
    """Node vectors with the coordinates of their centre in place of its number, for nodes named '<prefix>:<id>'; others stay.

    ``centres`` (id, value...); a node whose centre is unknown keeps its name.
    """
    c = centres.select(F.concat(F.lit(prefix + ":"), F.col("id").cast("string")).alias("node"), F.concat_ws(",", *(F.col(v).cast("string") for v in value)).alias("_at"))
    return vectors.join(c, "node", "left").withColumn("node", F.coalesce(F.concat(F.lit(prefix + ":"), "_at"), "node")).drop("_at")


def needed_vectors(vectors: DataFrame, ids: DataFrame, key: str = "tid") -> DataFrame:
    """Rows of ``vectors`` whose key is among ``ids``; the scan of the vectors is filtered, nothing is copied."""
    return vectors.join(ids.select(key).distinct(), key, "left_semi")


# words and phrases


def count_lines(counts: DataFrame, key: str = "word", count: str = "cnt") -> DataFrame:
    return counts.select(F.concat_ws(" ", key, F.col(count).cast("string")).alias("value"))


def parse_counts(lines: DataFrame) -> DataFrame:
    """(word, cnt): everything before the last blank is the word."""
    return _text(lines).select(F.regexp_extract("value", "^(.*) ([0-9]+)$", 1).alias("word"), F.regexp_extract("value", "^(.*) ([0-9]+)$", 2).try_cast("bigint").alias("cnt")).where("cnt is not null")


def distribution_lines(cells: DataFrame) -> DataFrame:
    """One JSON object a word, {"word", "cells": {cell: n}}, from (word, cell, n); a word has at most as many entries as the
    grid has cells."""
    each = F.map_from_entries(F.collect_list(F.struct(F.col("cell").cast("string"), "n")))
    return cells.groupBy("word").agg(each.alias("cells")).select(F.to_json(F.struct("word", "cells")).alias("value"))


def parse_distribution(lines: DataFrame) -> DataFrame:
    """(word, cell, n)."""
    d = _text(lines).select(F.from_json("value", "word string, cells map<string, bigint>").alias("d"))
    return d.select("d.word", F.explode("d.cells").alias("cell", "n")).withColumn("cell", F.col("cell").try_cast("bigint"))


def phrase_lines(phrases: DataFrame, *numbers: str) -> DataFrame:
    """phrase and numbers, separated by commas."""
    return phrases.select(F.concat_ws(",", "phrase", *(F.col(c).cast("string") for c in numbers)).alias("value"))


def parse_phrases(lines: DataFrame, *numbers: str) -> DataFrame:
    """(phrase in lower case, numbers...): patterns, rankings, probabilities; a line without numbers (a heading) is left out."""
    first = _field(1, ",", "double")
    return _text(lines).where(first.isNotNull()).select(F.lower(_field(0, ",")).alias("phrase"), *(_field(i + 1, ",", "double").alias(c) for i, c in enumerate(numbers)))


def parse_stopwords(lines: DataFrame) -> DataFrame:
    """(word): one a line, lower case, each once."""
    return _text(lines).select(F.lower(F.trim("value")).alias("word")).distinct()


def save_model(path: str, **tables: DataFrame) -> None:
    """Every table of a model in its own folder below ``path``."""
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame] | None:
    """The tables of a saved model, or null if one of them is missing: it must then be fitted."""
    from geoloom.storage import file_system

    for name in names:
        where, files = file_system(spark, f"{path}/{name}/_SUCCESS")
        if not files.exists(where):
            return None
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
