"""Registered queries: the operators bound to tables, and the same as SQL."""
