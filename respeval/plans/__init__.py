"""Whole runs built from the operators, and the queries of the entry point."""
