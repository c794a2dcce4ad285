"""Stages, planners and the query catalogue."""
