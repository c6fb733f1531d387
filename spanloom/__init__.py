"""Span analytics on Spark: parse, ground, score and compare text selections."""
