"""Readers and writers for the on-disk layouts."""
