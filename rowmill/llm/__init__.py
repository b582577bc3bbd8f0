"""Training-data operators: deduplication, cleaning, detection, decontamination and packing."""
