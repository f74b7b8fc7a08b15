"""Operators for preparing training text at scale, each on its own; nothing else in the library imports them."""
