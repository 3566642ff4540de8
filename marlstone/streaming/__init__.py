"""marlstone.streaming."""
