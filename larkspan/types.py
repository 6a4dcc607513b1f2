"""Schemas and errors."""

from __future__ import annotations

POINTS = "id string, vector array<float>, metadata map<string,string>"
CHANGE_LOG = "seq bigint, op string, id string, vector array<float>, metadata map<string,string>, crc bigint"


class VectorError(Exception):
    """What the engine raises."""


class EmptyVector(VectorError):
    def __init__(self):
        super().__init__("a vector must have an element")


class DimensionMismatch(VectorError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"dimension {actual} where {expected} is expected")
        self.expected, self.actual = expected, actual


class NotFound(VectorError):
    pass


class AlreadyExists(VectorError):
    pass


class InvalidParameter(VectorError):
    pass


class StorageError(VectorError):
    pass


class FormatError(VectorError):
    pass


def check_k(k: int) -> int:
    if k < 1:
        raise InvalidParameter("k must be at least 1")
    return k
