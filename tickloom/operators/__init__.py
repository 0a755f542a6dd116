"""Part of tickloom: operators."""
