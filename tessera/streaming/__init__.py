"""Keyed state kept current from edit and command streams."""
