"""Operators that prepare training text at scale; nothing outside this package imports them."""
