"""Sources, sinks and the snapshot store."""
