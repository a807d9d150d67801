"""Readers, writers and domain tables."""
