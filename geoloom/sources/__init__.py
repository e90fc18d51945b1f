"""Scans of the tables and text layouts."""
