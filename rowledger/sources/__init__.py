"""Readers and writers of table sets, change logs and control tables."""
