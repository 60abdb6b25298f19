"""plans of the event-log engine."""
