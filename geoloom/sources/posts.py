"""Posts in their canonical view, the text layouts they come in, and their sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.sources.tables import has_place, table, tokens

COLUMNS = ["tid", "uid", "lat", "lng", "created_at", "ts", "words", "raw", "poi_id", "category"]


def posts(spark: SparkSession, sf_dir: str, *columns: str, located: bool = False) -> DataFrame:
    """The wanted columns of every post with a tid, so that the scan reads no others; rows equal in them collapse.

    Repeated rows of a tid differ in ``ingested_at`` only, so without that column a tid has one row; should other columns
    differ, it keeps a row for each difference.
    """
    want = ["tid", *[c for c in (columns or COLUMNS) if c != "tid"]]
    t = table(spark, sf_dir, "tweet").select(*dict.fromkeys([*want, *(["lat", "lng"] if located else [])])).where("tid is not null")
    return (t.where(has_place()) if located else t).distinct()


def post_tokens(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """One row for each token occurrence: tid, the wanted columns, position from 1, word."""
    p = posts(spark, sf_dir, "words", *columns)
    return p.select("tid", *columns, F.posexplode(tokens("words")).alias("pos", "word")).withColumn("pos", F.col("pos") + 1)


def _field(i: int, kind: str | None = None, sep: str = "\x01") -> Column:
    f = F.get(F.split("value", sep, -1), F.lit(i))
    return f if kind is None else F.expr(f"try_cast(get(split(value, '{sep}', -1), {i}) as {kind})")


def parse_clean(lines: DataFrame, sep: str = "\x01", on_error: str = "fail") -> DataFrame:
    """Clean post lines (value): tid, uid, lat, lng, created_at, ts, words, raw and, where present, the POI fields.

    ``on_error``: 'fail' raises on a malformed line (fewer than 8 fields or a number that is none), 'drop' leaves it out.
    Empty POI coordinates become null.
    """
    n = F.size(F.split("value", sep, -1))
    out = lines.select(
        _field(0, "bigint", sep).alias("tid"), _field(1, "bigint", sep).alias("uid"), _field(2, "double", sep).alias("lat"), _field(3, "double", sep).alias("lng"),
        _field(4, None, sep).alias("created_at"), _field(5, "double", sep).cast("bigint").alias("ts"), F.split(_field(6, None, sep), " ", -1).alias("words"), _field(7, None, sep).alias("raw"),
        _field(8, None, sep).alias("poi_id"), _field(9, "double", sep).alias("poi_lat"), _field(10, "double", sep).alias("poi_lng"),
        F.coalesce(_field(11, None, sep), F.lit("")).alias("category"), _field(12, None, sep).alias("poi_name"), (n >= 8).alias("_ok"),
    )
    good = F.col("_ok") & F.col("tid").isNotNull() & F.col("uid").isNotNull() & F.col("lat").isNotNull() & F.col("lng").isNotNull() & F.col("ts").isNotNull()
    if on_error == "drop":
        return out.where(good).drop("_ok")
    return out.withColumn("tid", F.when(good, F.col("tid")).otherwise(F.raise_error(F.lit("malformed post line")).cast("bigint"))).drop("_ok")


def parse_legacy(lines: DataFrame, layout: str = "ny", sep: str = "\x01") -> DataFrame:
    """Older layouts: 'ny' has words at 6; 'checkin' has a category at 6 and words at 7."""
    words, category = (_field(6, None, sep), F.lit("")) if layout == "ny" else (_field(7, None, sep), _field(6, None, sep))
    return lines.select(
        _field(0, "bigint", sep).alias("tid"), _field(2, "double", sep).alias("lat"), _field(3, "double", sep).alias("lng"), _field(5, "double", sep).cast("bigint").alias("ts"),
        F.filter(F.split(words, "\\s+"), lambda w: w != "").alias("words"), category.alias("category"),
    )


def parse_json_posts(lines: DataFrame) -> DataFrame:
    """Posts of a document store, one JSON object a line; its phrases take the place of words."""
    s = F.from_json("value", "id bigint, uid bigint, time string, timestamp bigint, lat double, lng double, text string, phrases array<string>")
    return lines.select(s.alias("s")).select(
        F.col("s.id").alias("tid"), "s.uid", "s.lat", "s.lng", F.col("s.time").alias("created_at"), F.col("s.timestamp").alias("ts"), F.col("s.phrases").alias("words"), F.col("s.text").alias("raw")
    )


def to_clean_lines(df: DataFrame, sep: str = "\x01") -> DataFrame:
    """The clean layout as one column of text; ``words`` is an array."""
    return df.select(F.concat_ws(sep, "tid", "uid", "lat", "lng", "created_at", "ts", F.array_join("words", " "), "raw").alias("value"))


def parse_tagged(lines: DataFrame) -> DataFrame:
    """Tagger output (line_no, value): (post_no, pos, token, tag, confidence); a blank line ends a post.

    The post number is a running count of blank lines: a window over the file's own line numbers, partial counts first.
    """
    from pyspark.sql import Window

    block = lines.withColumn("_b", F.floor(F.col("line_no") / 100_000))
    per = block.groupBy("_b").agg(F.sum((F.trim("value") == "").cast("int")).alias("_n"))
    before = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    run = F.sum((F.trim("value") == "").cast("int")).over(Window.partitionBy("_b").orderBy("line_no"))
    t = block.join(F.broadcast(before.select("_b", "_before")), "_b").withColumn("post_no", run + F.col("_before")).where(F.trim("value") != "")
    f = F.split("value", "\t")
    t = t.select("post_no", "line_no", f[0].alias("token"), F.get(f, F.lit(1)).alias("tag"), F.expr("try_cast(get(split(value, '\t'), 2) as double)").alias("confidence"))
    pos = F.row_number().over(Window.partitionBy("post_no").orderBy("line_no"))
    return t.withColumn("pos", pos).select("post_no", "pos", "token", "tag", "confidence")


def query_lines(lines: DataFrame) -> DataFrame:
    """(query_id, bin_id): lines (line_no, value) of bin ids; the query id is the line number."""
    ids = F.transform(F.filter(F.split(F.trim("value"), "\\s+"), lambda x: x != ""), lambda x: x.cast("int"))
    return lines.select(F.col("line_no").alias("query_id"), F.explode(ids).alias("bin_id"))


def save(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None, **options: str) -> None:
    """Sink: parquet, json, csv (tab-separated with sep='\\t') or text; partitioned if asked."""
    w = df.write.mode("overwrite").format(fmt).options(**options)
    (w.partitionBy(*partition_by) if partition_by else w).save(path)
