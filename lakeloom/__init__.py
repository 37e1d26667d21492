"""Layered lakehouse analytics as plain PySpark DataFrame functions."""
