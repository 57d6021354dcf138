"""Inventory and sales analytics as composable PySpark DataFrame functions."""
