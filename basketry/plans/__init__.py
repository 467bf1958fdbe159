"""Reusable plan fragments: fact tables, distributed ordering, scalars."""
