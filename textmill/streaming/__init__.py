"""textmill.streaming."""
