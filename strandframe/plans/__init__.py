"""Plan shapes shared by the operators: block scans, tiles, bins, storage."""
