"""Queries over the tables, each with the SQL that it must agree with."""
