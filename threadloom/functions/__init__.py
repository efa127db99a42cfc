"""Column functions of the record model."""

from .text import *  # noqa: F403
