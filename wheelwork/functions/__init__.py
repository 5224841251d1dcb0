"""Functions of the mobility engine."""
