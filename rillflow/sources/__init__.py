"""Files, stored tables and what is written to them."""
