"""Corpora as tables and graphs, and their preparation and scoring for language models, in PySpark."""
