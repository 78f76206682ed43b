"""Whole jobs built from operators, and the tables they read and write."""
