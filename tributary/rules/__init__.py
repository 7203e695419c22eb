"""rules."""
