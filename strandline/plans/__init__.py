"""Queries over the driver's tables, built from the operators, with their SQL twins."""
