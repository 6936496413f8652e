"""Operators: cleaning stages, profiling and explorations, each DataFrame -> DataFrame."""
