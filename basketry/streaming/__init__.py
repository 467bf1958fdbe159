"""Micro-batch refresh of operator results as new star files arrive."""

from basketry.streaming.refresh import refresh_on_arrival

__all__ = ["refresh_on_arrival"]
