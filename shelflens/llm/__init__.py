"""Operators for training-data pipelines: text, near-duplicate, archive and tokenizer jobs."""
