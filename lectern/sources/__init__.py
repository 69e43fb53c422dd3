"""Sources and sinks: inventory, multi-format readers, writers, compaction."""
