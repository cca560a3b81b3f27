"""Reading source tables and writing report tables."""
