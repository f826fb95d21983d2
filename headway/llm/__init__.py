"""Training-data operators; nothing else in headway imports this subpackage."""
