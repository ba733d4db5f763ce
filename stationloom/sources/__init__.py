"""Source specifications, readers and writers."""
