"""Whole plans built from the operators, and the registry of queries."""
