"""Readers, typed projection, upserts and sinks."""
