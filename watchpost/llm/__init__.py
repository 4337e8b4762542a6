"""Training-data operators: packing, decontamination, near duplicates, quality, safety."""
