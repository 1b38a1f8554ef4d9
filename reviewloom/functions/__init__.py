"""Column-expression library (scalar rules H1-H19 and filters F1-F9)."""

from . import display, scrub, text, vectors, weeks  # noqa: F401
