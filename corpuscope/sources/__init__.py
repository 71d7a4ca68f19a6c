"""Readers of files and change feeds, and writers of reports."""
