"""Encoders and the operators on documents."""
