"""Incremental loading of arriving staging snapshots."""
