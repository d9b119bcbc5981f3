"""Risk-table, guideline-text and feedback analytics as Spark jobs."""
