"""p1: posts near places and inside districts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.operators.nearby import within_distance, within_regions
from geoloom.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, kind, place_id): POIs at most 100 m from a post's place, and districts that hold it."""
    posts = table(spark, sf_dir, "tweet").select("tid", "lat", "lng")
    near = within_distance(posts, table(spark, sf_dir, "poi"), 100.0, id_col="tid", place_id="poi_id")
    inside = within_regions(posts, table(spark, sf_dir, "district"), id_col="tid", region_id="district_id")
    near = near.select(F.col("id").alias("tid"), F.lit("poi").alias("kind"), "place_id")
    inside = inside.select(F.col("id").alias("tid"), F.lit("district").alias("kind"), F.col("region_id").alias("place_id"))
    return near.unionByName(inside)


QUERIES = {"p1_found": p1_found}

ORACLES = {
    "p1_found": """
WITH place AS (
  SELECT DISTINCT tid, lat, lng - 360 * floor((lng + 180) / 360) AS lng FROM tweet
  WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng) AND lat BETWEEN -90 AND 90 AND abs(lng) < 1e15
    AND NOT (lat = 0 AND lng = 0)),
spot AS (
  SELECT DISTINCT poi_id, lat, lng - 360 * floor((lng + 180) / 360) AS lng FROM poi
  WHERE lat IS NOT NULL AND lng IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lng) AND lat BETWEEN -90 AND 90 AND NOT (lat = 0 AND lng = 0)),
near AS (
  SELECT DISTINCT tid, 'poi' AS kind, poi_id AS place_id FROM place p JOIN spot s
    ON p.lat BETWEEN s.lat - 0.001 AND s.lat + 0.001
  WHERE 2 * 6373000 * asin(least(1, sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2)
    + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - p.lng) / 2), 2)))) <= 100),
ring AS (SELECT district_id, unnest(rings) AS r FROM district),
numbered AS (SELECT district_id, row_number() OVER (ORDER BY district_id, r) AS ring_no, r FROM ring),
edge AS (
  SELECT district_id, ring_no, r[i].lat AS y1, r[i].lng AS x1, r[i % len(r) + 1].lat AS y2, r[i % len(r) + 1].lng AS x2
  FROM (SELECT district_id, ring_no, r, unnest(range(1, len(r) + 1)) AS i FROM numbered)),
inside AS (
  SELECT tid, district_id FROM place p JOIN edge e ON (y1 <= p.lat) <> (y2 <= p.lat)
  WHERE (x1 + (p.lat - y1) / (y2 - y1) * (x2 - x1 - 360 * floor((x2 - x1 + 180) / 360)) - p.lng)
    - 360 * floor(((x1 + (p.lat - y1) / (y2 - y1) * (x2 - x1 - 360 * floor((x2 - x1 + 180) / 360)) - p.lng) + 180) / 360) > 0
  GROUP BY tid, district_id HAVING count(*) % 2 = 1)
SELECT tid, kind, place_id FROM near
UNION ALL SELECT tid, 'district' AS kind, district_id AS place_id FROM inside""",
}
