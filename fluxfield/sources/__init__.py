"""Readers with validation, and writers."""
