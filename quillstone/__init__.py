"""Quillstone: relational, ingestion and event-processing operators as pure functions of Spark DataFrames."""
