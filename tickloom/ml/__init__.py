"""Model training and search over feature tables."""
