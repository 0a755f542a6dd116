"""Part of tickloom: sources."""
