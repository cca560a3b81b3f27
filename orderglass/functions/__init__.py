"""Column expressions used inside the reporting jobs."""
