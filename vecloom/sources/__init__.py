"""Readers, writers and table views."""
from vecloom.sources.session import ensure_checkpoint_dir, partitions_for, session, spread, table

__all__ = ["ensure_checkpoint_dir", "partitions_for", "session", "spread", "table"]
