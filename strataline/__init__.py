"""strataline: documents of many kinds into addressable segments, as Spark DataFrames."""
