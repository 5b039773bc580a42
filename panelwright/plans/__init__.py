"""Plans of the panel engine."""
