"""Ratings analytics as composable PySpark DataFrame functions."""
