"""Where results go besides lake tables."""
