"""Operators for training-data pipelines. Nothing outside this folder imports it but the entry module and corpus_pipeline."""
