"""Permuted group labels of many (fold, repeat) without a row for each of them.

Under a fold and a repeat the rows outside the fold stand in the order of SHA-256 of (seed, fold, repeat, path), equal ones by a unique number, and
the groups lie on that order one after the other, each as long as it is. A label therefore follows from the few places where a group
begins: these are found by counting leading bits, then by ordering what shares them with such a place. A row carries four bytes of its digest
a (fold, repeat); a full digest is made again only for the rows whose four bytes equal those of a place.
"""

from __future__ import annotations

import hashlib
import sys
from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

# The helpers below travel with the task, so executors need NumPy but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a digest that a row carries for each (fold, repeat).
KEY_BYTES = 4


def head(seed: int, fold: str, repeat: int) -> str:
    """What is digested before a row's path."""
    return f"{seed}|{fold}|{repeat}"


def packed_keys(heads: Sequence[str], path: Column) -> Column:
    """The first bytes of the row's digests under all ``heads``, one after the other."""
    digest = lambda h: F.substring(F.sha2(F.concat_ws("|", h, path.cast("string")), 256), 1, 2 * KEY_BYTES)
    return F.unhex(F.array_join(F.transform(F.array(*[F.lit(h) for h in heads]), digest), ""))


def bits_for(groups: int) -> int:
    """Leading bits to count by: the buckets in which a group begins then hold few of the rows."""
    return min(16, max(10, (32 * groups - 1).bit_length()))


def words(start: str, tails: Sequence[str | None], ids: np.ndarray) -> np.ndarray:
    """The order of rows: four words of the digest and the unique number. ``tails``: the paths; a missing one adds nothing to the text."""
    first = start.encode()
    digests = b"".join(hashlib.sha256(first if t is None else first + b"|" + t.encode()).digest() for t in tails)
    return np.column_stack([np.frombuffer(digests, ">u8").reshape(-1, 4).astype(np.uint64), np.asarray(ids, np.int64).astype(np.uint64)])


def buckets(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> np.uint32(8 * KEY_BYTES - bits)).astype(np.int64)


def starts_in(counts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, place in it) of the first row of every group but the first; ``counts``: rows a bucket, ``sizes``: rows a group, in order."""
    below = np.concatenate([[0], np.cumsum(counts)])
    starts = np.cumsum(sizes)[:-1]
    bucket = np.searchsorted(below, starts, "right") - 1
    return bucket, starts - below[bucket]


def bounds(found: np.ndarray, bits: int, bucket: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The words of the rows where a group begins; ``found``: the words of all rows of these buckets."""
    ordered = found[np.lexsort(found.T[::-1])]
    return ordered[np.searchsorted((ordered[:, 0] >> np.uint64(64 - bits)).astype(np.int64), bucket, "left") + place]


def places(limits: np.ndarray, start: str, key: np.ndarray, tails: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How many ``limits`` each row has reached, which is the place of its group in the order of groups."""
    first = (limits[:, 0] >> np.uint64(64 - 8 * KEY_BYTES)).astype(key.dtype)
    at = np.searchsorted(first, key, "left")
    tied = np.flatnonzero(np.append(first, 0)[at] == key) if len(first) else []
    tied = [i for i in tied if at[i] < len(first)]
    if tied:
        exact = [tuple(x) for x in limits.tolist()]
        at[tied] = [bisect_right(exact, tuple(x)) for x in words(start, tails[tied], ids[tied]).tolist()]
    return at
