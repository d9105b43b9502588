"""Readers, writers and fixed reference tables."""
