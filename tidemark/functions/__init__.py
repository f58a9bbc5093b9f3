"""Column functions: normalisation of units, levels, ids and scores."""
