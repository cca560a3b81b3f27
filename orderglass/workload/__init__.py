"""The registered queries: the operators applied to the benchmark tables, with their SQL twins."""
