"""DataFrame operators: table steps, positions, records, evaluation, datasets."""
