"""Sources of the command-history engine."""
