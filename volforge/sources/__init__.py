"""Table loading, derived fixture views, readers and sinks."""
