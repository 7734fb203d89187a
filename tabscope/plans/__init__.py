"""Whole-table and batch plans built from the operators."""
