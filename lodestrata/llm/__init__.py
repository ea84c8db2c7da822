"""Training-data operators; nothing else in lodestrata imports this subpackage."""
