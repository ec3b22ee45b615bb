"""Incremental versions of ingest, resampling and spike flags."""
