"""The commerce-analytics operators; each is ``op(star, **params) -> DataFrame``."""
