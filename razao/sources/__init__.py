"""Readers for statements and service invoices, table scans, and the report sink."""
