"""Operators of a training-data pipeline on documents, pages, chats and vectors.

Nothing outside this package, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
Every operator selects the columns it is told to read and returns new columns
beside the key, so other columns of the input, whatever their names, never
clash with its own.
"""
