"""Storage: files, the command log, the catalog and snapshots."""
