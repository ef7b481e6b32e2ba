"""Spark analytics over repeated question-answering runs and their web-search logs."""
