"""Multiset overlaps of the n-grams of many pairs at once, and alignments of their items, by column.

Items are numbered over the whole batch, n-grams by pairing the number of the gram before with the item that
follows, so that numbers stay exact and no row is looked at on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

Side = tuple[np.ndarray, np.ndarray]  # item numbers and the row of each


def _rows(lengths: pa.Array) -> np.ndarray:
    return np.repeat(np.arange(len(lengths)), pc.fill_null(lengths, 0).to_numpy(zero_copy_only=False))


def of_lists(a: pa.Array, b: pa.Array) -> tuple[Side, Side]:
    """The items of two list columns, numbered together; null lists are empty."""
    flat = [pc.list_flatten(x).cast(pa.large_string()) for x in (a, b)]
    codes = pa.concat_arrays(flat).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(flat[0])
    return (codes[:n], _rows(pc.list_value_length(a))), (codes[n:], _rows(pc.list_value_length(b)))


def of_texts(a: pa.Array, b: pa.Array) -> tuple[Side, Side]:
    """The code points of two text columns; null texts are empty."""
    out = []
    for x in (a, b):
        points = np.frombuffer("".join(t for t in x.to_pylist() if t).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        out.append((points, _rows(pc.utf8_length(x))))
    return out[0], out[1]


def longer(grams: tuple[Side, Side], items: tuple[Side, Side], n: int) -> tuple[Side, Side]:
    """The grams of n items from those of n - 1."""
    keys, rows = [], []
    size = max((int(s[0].max()) for s in items if len(s[0])), default=0) + 1
    for (gram, row), (item, at) in zip(grams, items):
        # the k-th gram of a row starts at its k-th item; rows shorter than n have none
        first = np.flatnonzero(at[: len(at) - n + 1] == at[n - 1 :]) if len(at) >= n else np.zeros(0, np.int64)
        start = np.flatnonzero(at[: len(at) - n + 2] == at[n - 2 :]) if len(at) >= n - 1 else np.zeros(0, np.int64)
        keys.append(gram[np.searchsorted(start, first)] * size + item[first + n - 1])
        rows.append(at[first])
    number = np.unique(np.concatenate(keys), return_inverse=True)[1].reshape(-1)
    return (number[: len(keys[0])], rows[0]), (number[len(keys[0]) :], rows[1])


def shared(a: Side, b: Side, n_rows: int) -> np.ndarray:
    """Per row how many grams both sides share as multisets."""
    size = max((int(s[0].max()) for s in (a, b) if len(s[0])), default=0) + 1
    (x, nx), (y, ny) = (np.unique(row * size + gram, return_counts=True) for gram, row in (a, b))
    both, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return np.bincount(both // size, np.minimum(nx[i], ny[j]), n_rows)


def aligned(a: Side, b: Side) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the items that meet, in the order of ``a``: the row, and the place in the batch on either side.

    The k-th occurrence of an item in a row meets the k-th on the other side.
    """
    size = max((int(s[0].max()) for s in (a, b) if len(s[0])), default=0) + 1
    keys = [row * size + item for item, row in (a, b)]
    (x, nx), (y, ny) = (np.unique(k, return_counts=True) for k in keys)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    met = np.minimum(nx[i], ny[j])
    k = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met)
    here, there = (np.argsort(key, kind="stable")[np.repeat((np.cumsum(n) - n)[at], met) + k] for key, n, at in zip(keys, (nx, ny), (i, j)))
    order = np.argsort(here)
    return a[1][here[order]], here[order], there[order]


def count(side: Side, n_rows: int) -> np.ndarray:
    return np.bincount(side[1], minlength=n_rows)


def with_short(grams: tuple[Side, Side], a: pa.Array, b: pa.Array, n: int) -> tuple[Side, Side]:
    """The grams, and each text shorter than n as its own only gram."""
    size = max((int(s[0].max()) for s in grams if len(s[0])), default=0) + 1
    whole = pa.concat_arrays([x.cast(pa.large_string()) for x in (a, b)]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    out = []
    for (gram, row), x, ids in zip(grams, (a, b), (whole[: len(a)], whole[len(a) :])):
        length = pc.fill_null(pc.utf8_length(x), 0).to_numpy(zero_copy_only=False)
        short = np.flatnonzero((length > 0) & (length < n))
        out.append((np.concatenate([gram, size + ids[short]]), np.concatenate([row, short])))
    return out[0], out[1]


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
