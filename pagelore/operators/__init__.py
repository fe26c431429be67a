"""Set-based jobs: prototypes, search, families, supervised classification, the catalog."""
