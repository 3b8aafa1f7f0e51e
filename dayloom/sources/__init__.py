"""File checks, readers and sinks."""
