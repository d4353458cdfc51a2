"""Evaluation analytics on Spark: coverage-aware scores, paired contrasts, agreement,
bootstrap intervals, splits and dataset cleaning as DataFrame operators."""
