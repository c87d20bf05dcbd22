"""Operators of a training-data pipeline, over ``documents``, ``pages`` and ``conversations``.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it.
"""
