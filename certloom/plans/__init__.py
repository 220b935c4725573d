"""Multi-step plans: ingest, rebuild."""
