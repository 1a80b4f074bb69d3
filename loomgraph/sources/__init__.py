"""Reading tables, listings, metadata and snapshots; writing metadata; shared scratch tables."""
