"""Readers, writers and the prompt registry."""
