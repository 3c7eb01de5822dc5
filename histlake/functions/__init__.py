"""Functions of the command-history engine."""
