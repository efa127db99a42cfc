"""Operators over record logs, as functions from DataFrames to DataFrames."""

from .relational import *  # noqa: F403
from .sequence import *  # noqa: F403
