"""Training-data operators: quality, language, licences, dedup, decontamination, mixing, sharding."""
