"""Queries over the tables, with the SQL that they must agree with."""
