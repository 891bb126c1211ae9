"""Feature-selection operators."""
