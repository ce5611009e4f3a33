"""Readers and writers of intake files, result documents and result tables."""
