"""Training-data operators: sharding, decontamination, chat formatting, dedup, packing, scoring."""
