"""Queries that bind the operators to tables of a data folder, each beside the SQL that must give the same rows."""
