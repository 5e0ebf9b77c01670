"""Column functions: values, derived columns, answer scoring."""
