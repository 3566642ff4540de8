"""marlstone.functions."""
