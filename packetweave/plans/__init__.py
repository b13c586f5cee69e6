"""Whole analyses and reports composed from the operators."""
