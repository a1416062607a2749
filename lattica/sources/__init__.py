"""Graph sources and sinks."""
