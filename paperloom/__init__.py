"""Document analytics on Spark: evidence tables, planning, evaluation and routing as DataFrame plans."""
