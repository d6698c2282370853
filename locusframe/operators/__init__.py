"""Operators over annotation frames."""
