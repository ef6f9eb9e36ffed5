"""Operators on relations of cells, lines, runs and pages."""
