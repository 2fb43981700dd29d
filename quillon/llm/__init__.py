"""Operators for preparing large text corpora: media, dedup, language, quality, mixing, tokens."""
