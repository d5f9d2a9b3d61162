"""Token-usage analytics for agent sessions on Spark: log records to usage events, a versioned ledger, cost queries."""
