"""Readers and writers of JSON lines, id lists, catalogs and tables."""
