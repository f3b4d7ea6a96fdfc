"""Structured Streaming forms of the execution-log reports."""
