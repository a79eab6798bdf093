"""Native column expressions shared by the operators."""
