"""Operators of the command-history engine."""
