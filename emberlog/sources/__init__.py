"""Sources and sinks: topics, tables of events, legacy snapshots."""
