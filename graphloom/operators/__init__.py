"""Graph operators: traversal, patterns, analytics, search, changes, maintenance."""
