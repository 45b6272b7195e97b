"""Queries over the driver's tables, by theme; importing this package registers them all."""

from priorline.queries import adapters, frame, metrics, models, pit, policy, ratings, relational, scalars, splits  # noqa: F401
