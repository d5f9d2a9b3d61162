"""Readers of session logs and the snapshot ledger."""
