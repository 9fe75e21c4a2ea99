"""Structured Streaming forms of the import and the audit log."""
