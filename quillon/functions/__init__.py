"""Scalar functions of the engine, as built-in column expressions."""
