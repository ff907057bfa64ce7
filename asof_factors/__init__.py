"""Point-in-time factor research on Spark: DataFrame in, DataFrame out."""
