"""Sources of the mobility engine."""
