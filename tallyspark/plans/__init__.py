"""Whole-report plans and the registered query catalogue."""
