"""marlstone.operators."""
