"""Readers, writers, configuration and the shared work folder."""
