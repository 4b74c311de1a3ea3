"""Views that follow their table."""
