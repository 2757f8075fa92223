"""vellum: transcript and text analytics expressed as Spark DataFrames."""
