"""korvane: composable verbs over tables of records, documents and vectors, compiled to Spark DataFrames."""
