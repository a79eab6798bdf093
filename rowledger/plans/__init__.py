"""Whole runs: change log generation and integration."""
