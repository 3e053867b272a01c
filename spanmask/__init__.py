"""Sensitive-span detection, arbitration and replacement on PySpark DataFrames."""
