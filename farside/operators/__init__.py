"""DataFrame operators of the imaging chain."""
