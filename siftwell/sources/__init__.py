"""Readers and writers of report, feed, result and export files."""
