"""Readers, payload parsers, registry operators and sinks."""
