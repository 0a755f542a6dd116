"""Part of tickloom: functions."""
