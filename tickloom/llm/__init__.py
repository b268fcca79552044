"""Corpus operators for training-data pipelines.

Self-contained: nothing outside this subpackage (and corpus_pipeline.py) imports it.
"""
