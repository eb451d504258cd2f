"""Near-infrared spectroscopy recordings as Spark DataFrames."""
