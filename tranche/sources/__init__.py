"""Sources and sinks: raw-table scans, the test-data adapter, stored tables."""
