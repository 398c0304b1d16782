"""Structured Streaming counterparts of the ledger, triage and telemetry operators."""
