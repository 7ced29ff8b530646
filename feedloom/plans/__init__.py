"""Plan helpers: sessions, lineage and size checks."""
