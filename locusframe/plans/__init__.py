"""Whole plans: building, opening and querying an index; queries over the driver's tables."""
