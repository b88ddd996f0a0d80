"""Timed-text analytics on Spark: composable DataFrame -> DataFrame operators."""
