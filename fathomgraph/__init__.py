"""Spark-first analytics over code graphs: two DataFrames (nodes, edges) and everything derived from them."""
