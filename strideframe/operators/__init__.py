"""Operators over track, landmark, label and score tables."""
