"""Documents made from tables."""
