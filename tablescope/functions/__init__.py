"""Scalar column functions: canonical text form and display formats."""
from tablescope.functions.text import to_text  # noqa: F401
