"""Iterative jobs built from operators."""
