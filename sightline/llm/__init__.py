"""Operators on listing texts and entities; nothing else in the library imports this subpackage."""
