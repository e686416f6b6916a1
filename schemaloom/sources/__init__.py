"""Readers and writers: models, JSONL, TSV, CSV and mapping sets."""
