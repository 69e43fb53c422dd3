"""Learning-analytics engine built from Spark DataFrames, Spark SQL, Spark ML and Structured Streaming."""
