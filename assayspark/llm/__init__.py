"""Training-data operators; nothing else of the library imports this subpackage."""
