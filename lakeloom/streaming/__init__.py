"""Change streams applied to lake tables."""
