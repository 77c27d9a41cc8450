"""Area-density and address-matching operators on Spark DataFrames."""
