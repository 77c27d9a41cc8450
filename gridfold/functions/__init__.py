"""Column expressions: names, addresses, postcodes, rings and centroids. No Python UDFs."""
