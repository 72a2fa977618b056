"""Marts, exploratory analyses, profile, reports and the three pipelines."""
