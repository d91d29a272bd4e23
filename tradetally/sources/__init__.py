"""Sources: file/query readers, file fingerprints and the feeds derived from the driver tables."""
