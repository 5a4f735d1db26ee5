"""Training-data operators: ten document-level operators and their queries."""
