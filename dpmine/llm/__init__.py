"""Training-data operators: language ID, near-duplicate and repeat removal, decontamination, mixing, token output."""
