"""Vocabulary."""
