"""Bindings of the operators to tables."""
