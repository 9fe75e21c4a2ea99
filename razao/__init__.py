"""Bank ledgers, reconciliation and cash flow over a portfolio of companies, on Spark."""
