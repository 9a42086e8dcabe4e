"""Operators for preparing training text: a self-contained subpackage that nothing else in the library imports."""
