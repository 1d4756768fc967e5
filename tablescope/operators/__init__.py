"""DataFrame operators of the exploration layer."""
