"""Operators that prepare training text. Nothing outside this subpackage imports it."""
