"""Scoring of streaming frames."""
