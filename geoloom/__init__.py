"""Geo-text analytics on Spark: posts with time, place and words, from scan to ranked event candidates."""
