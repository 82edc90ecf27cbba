"""Raw snapshots, staging, the snapshot ledger, keyed tables and processed products."""
