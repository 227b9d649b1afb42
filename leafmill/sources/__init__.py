"""Readers, writers and byte codecs."""
