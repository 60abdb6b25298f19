"""streaming of the event-log engine."""
