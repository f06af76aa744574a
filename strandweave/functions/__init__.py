"""Column functions: base codes, complements, packing, fingerprints."""
