"""Readers, loaders and the chunk store."""
