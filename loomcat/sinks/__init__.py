"""File sinks and catalog tables."""
