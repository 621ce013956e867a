"""Operators over training corpora: extraction, fingerprints, filters, joins, tokens and archives."""
