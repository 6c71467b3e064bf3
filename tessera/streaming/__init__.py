"""Rules, models and the monitor on streams."""
