"""Readers and writers of tables, records and run folders."""
