"""marlstone.sources."""
