"""Composite jobs: preprocessing, training and scoring."""
