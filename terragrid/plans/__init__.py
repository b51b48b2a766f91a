"""Part of terragrid."""

from . import areas, checks, files, queries, tracks  # noqa: F401  queries register themselves
