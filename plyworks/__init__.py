"""Game-record analytics on Spark: DataFrame in, DataFrame out."""
