"""Perishable-retail analytics as Spark DataFrames."""
