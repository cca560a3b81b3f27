"""Whole reports and join plans composed from the operators."""
