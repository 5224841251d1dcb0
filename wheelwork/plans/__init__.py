"""Plans of the mobility engine."""
