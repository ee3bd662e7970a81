"""Operators for preparing training data: near copies, shards, languages, quality, tokens and pages."""
