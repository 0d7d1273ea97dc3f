"""Readers and writers of labelled tables, grids and performance tables."""
