"""Plumbline: lineage and impact analytics over property graphs, on Spark DataFrames."""
