"""Readers and writers of packages and versions."""
