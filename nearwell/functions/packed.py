"""Byte vectors: BINARY columns compared as they are, one byte a component.

A distance becomes its packed form (`packed`) for the kernels of exact searches. Squares come from a product of matrices (whole numbers below
2**53, hence exact), bits from exclusive or and popcount over 64-bit words; what is left over behind the last whole word counts too. Other
distances look at blocks of bytes as numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .distances import Distance, get

BLOCK = 512  # rows that are widened at a time


def _words(x: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words, zeros at the end."""
    short = -x.shape[1] % 8
    return np.ascontiguousarray(np.pad(x, ((0, 0), (0, short))) if short else x).view(np.uint64)


@dataclass(frozen=True)
class Packed(Distance):
    """A distance over rows of unsigned bytes."""

    def matrix(self, q: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.empty((len(q), len(b)))
        if self.binary:
            a, z = _words(q), _words(b)
            out[:] = 0
            for i in range(a.shape[1]):
                out += np.bitwise_count(a[:, i, None] ^ z[None, :, i])
            return out
        for at in range(0, len(b), BLOCK):
            x, y = q.astype(np.float64), b[at : at + BLOCK].astype(np.float64)
            if self.name in ("l2", "l2_simple"):
                out[:, at : at + BLOCK] = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T)
            else:
                out[:, at : at + BLOCK] = super().matrix(x, y)
        return out

    def pairs(self, q: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.binary:
            return np.bitwise_count(_words(q) ^ _words(b)).sum(axis=1).astype(np.float64)
        return super().pairs(q.astype(np.float64), b.astype(np.float64))

    def bounds(self, q: np.ndarray, b: np.ndarray, rough: bool = False) -> None:
        return None  # the products are exact already

    def screen(self, q: np.ndarray, b: np.ndarray) -> None:
        return None


def packed(distance: str | int | Distance) -> Packed:
    """A distance's form over BINARY columns."""
    d = get(distance)
    return d if isinstance(d, Packed) else Packed(**{f.name: getattr(d, f.name) for f in fields(Distance)})


def pack_bytes(v: Column) -> Column:
    """An array of whole numbers from 0 to 255 as BINARY; any other raises an error."""
    digit = lambda x: F.when((x >= 0) & (x <= 255), F.lpad(F.hex(x.cast("long")), 2, "0")).otherwise(F.raise_error(F.lit("components of byte vectors are 0 to 255")))
    return F.unhex(F.array_join(F.transform(v, digit), ""))


def unpack_bytes(v: Column) -> Column:
    """BINARY as an array of short."""
    n = F.octet_length(v)
    return F.when(n == 0, F.array().cast("array<short>")).otherwise(F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.hex(F.substring(v, i, F.lit(1))), 16, 10).cast("short")))
