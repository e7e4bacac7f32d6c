"""Operators on edge and node tables."""
