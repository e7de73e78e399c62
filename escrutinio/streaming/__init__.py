"""Structured Streaming ingestion of profile readings and posts."""
