"""Reading the input tables, writing derived ones."""
