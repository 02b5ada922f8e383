"""Readers, writers and keyed result tables."""
