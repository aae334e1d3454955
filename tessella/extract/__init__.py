"""Source text to fact rows."""
