"""Plans of the command-history engine."""
