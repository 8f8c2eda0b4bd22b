"""Readers, writers and append logs."""
