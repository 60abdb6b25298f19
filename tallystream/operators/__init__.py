"""operators of the event-log engine."""
