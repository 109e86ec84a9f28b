"""Micro-batch upserts and their running views."""
