"""Sources, sinks and stored tables."""
