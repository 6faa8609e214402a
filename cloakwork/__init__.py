"""Text-privacy, selection, evaluation and corpus operators for Spark DataFrames."""
