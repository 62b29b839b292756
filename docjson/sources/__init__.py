"""Text and schema sources, JSON sinks."""
