"""Research-integrity screening as Spark DataFrame programs."""
