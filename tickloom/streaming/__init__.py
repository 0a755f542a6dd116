"""Part of tickloom: streaming."""
