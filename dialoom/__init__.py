"""Streaming-dialogue analytics expressed as Spark DataFrames."""
