"""Operators: features (windows), rules, ranking metrics, sampling, ingest, models, attribution."""
