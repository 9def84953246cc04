"""Plans of the look-ups."""
