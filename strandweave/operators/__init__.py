"""Relational operators over reads and overlap edges."""
