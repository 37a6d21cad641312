"""Relational operators of the engine, as DataFrame compositions."""
