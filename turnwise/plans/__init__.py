"""Composite jobs built from the operators: feature blocks, models, evaluation."""
