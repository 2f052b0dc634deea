"""Whole questions: verdicts, the query catalogue and its SQL."""
