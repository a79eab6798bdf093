"""Operators on table sets and change logs."""
