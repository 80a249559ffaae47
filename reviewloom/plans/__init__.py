"""Whole jobs: named metrics, the report prompt, the full analysis."""
