"""Interval-event tail analytics as composable Spark DataFrame operators."""
