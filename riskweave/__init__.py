"""Rule-driven risk detection over text, dependency and event tables, on Spark DataFrames."""
