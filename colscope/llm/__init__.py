"""Operators for preparing training corpora: the rest of the library does not import this package."""
