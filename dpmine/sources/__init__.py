"""Readers, writers and the bindings to the driver's test tables."""
