"""Text of pipe queries to syntax trees."""
