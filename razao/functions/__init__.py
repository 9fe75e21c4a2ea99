"""Column expressions: money, text, dates and documents. No actions, no Python UDFs."""
