"""Errors that users of the library see."""


class ParseError(ValueError):
    """The input can't be read as a billing export."""
