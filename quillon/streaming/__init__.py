"""Keyed state over append logs."""
