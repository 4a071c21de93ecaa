"""Operators for preparing training data at corpus scale.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
