"""Training-data operators on Spark: chat formatting, search, deduplication, mixing, packing."""
