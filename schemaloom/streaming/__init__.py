"""Structured Streaming sources over landing folders."""
