"""Evidence analytics on Spark: DataFrame jobs over tables of work records."""
