"""Compositions of operators: warehouse load, silver tables, monthly forecast cycle."""
