"""Registered queries: every operator on the given tables, with the SQL that must give the same rows."""
