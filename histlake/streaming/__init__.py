"""Streaming of the command-history engine."""
