"""Whole jobs over the operators: configuration, manifests, indexing, asking, evaluating, and the command line."""
