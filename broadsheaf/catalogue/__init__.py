"""Registered queries, by theme; importing this package registers all of them."""

from . import audits, campaigns, extras, logs, pipeline, quality, rates, readings, scalars, search, windows  # noqa: F401
