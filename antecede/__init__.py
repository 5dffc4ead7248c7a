"""Mutation-order inference as Spark DataFrame jobs."""
