"""Quarry: record, document and conversation analytics as Spark jobs."""
