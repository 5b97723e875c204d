"""Queries over the given tables, one or more for each operator, and the SQL that they are checked against."""
