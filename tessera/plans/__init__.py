"""Sessions, lineage cuts and the orchestrated campaign."""
