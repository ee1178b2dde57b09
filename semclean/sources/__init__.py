"""Caches, payloads and other ends of the pipeline."""
