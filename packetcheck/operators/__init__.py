"""DataFrame operators: extraction, choice, reconciliation."""
