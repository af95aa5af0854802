"""Retrieval, conversation analytics and training-data jobs on Spark."""
