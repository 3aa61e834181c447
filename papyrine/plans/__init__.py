"""Plan-level helpers shared by all operators: reading, lineage cuts, batch sizes."""
