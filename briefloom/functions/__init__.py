"""Column builders: text, URL, date, hash and number functions."""

from briefloom.functions import dates, hashing, numbers, text, urls

__all__ = ["dates", "hashing", "numbers", "text", "urls"]
