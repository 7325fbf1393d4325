"""Queries that bind the operators to the given tables, each with the SQL that it is held against."""
