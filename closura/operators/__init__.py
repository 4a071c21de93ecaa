"""Operators over triples."""
