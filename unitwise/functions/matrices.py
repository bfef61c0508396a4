"""Numbers of many matrices at once: Arrow lists of decibels in, numpy over all lists of one size, Arrow out.

Null lists and lists with a null cell give null; empty lists give null or what is said for them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 1024
_KINDS = {"double": pa.float64(), "bigint": pa.int64(), "int": pa.int32()}
#: The properties of a matrix and their types.
PROPERTIES = {
    "peak_db": "double",
    "headroom": "double",
    "peak_row": "bigint",
    "peak_col": "bigint",
    "row_centroid": "double",
    "col_centroid": "double",
    "row_spread": "double",
    "col_spread": "double",
    "cells_10db": "bigint",
    "cells_20db": "bigint",
    "dynamic_range": "double",
    "mean_db": "double",
}


def blocks(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix): some lists of one size, of one cell at least, and where they stand."""
    rows = np.flatnonzero(pc.is_valid(lists).to_numpy(zero_copy_only=False))
    sizes = pc.list_value_length(lists).drop_null().to_numpy().astype(np.int64)
    flat = lists.flatten()
    starts = np.cumsum(sizes) - sizes
    if flat.null_count:
        holes = np.add.reduceat(np.append(pc.is_null(flat).to_numpy(zero_copy_only=False), 0), starts) * (sizes > 0) > 0
        rows, sizes, starts = rows[~holes], sizes[~holes], starts[~holes]
    cells = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]):
        mine = np.flatnonzero(sizes == n)
        for i in range(0, len(mine), STEP):
            at = mine[i : i + STEP]
            yield rows[at], cells[starts[at][:, None] + np.arange(n)]


def numbers(lists: pa.Array, of: Callable[[np.ndarray], np.ndarray], empty: float | None = None) -> pa.Array:
    """of(matrix) gives a number for each row, NaN-free integers or doubles; masked entries are null."""
    out, none = None, np.ones(len(lists), bool)
    for rows, x in blocks(lists):
        got = np.ma.asarray(of(x))
        out = np.zeros(len(lists), got.dtype if got.dtype == float else np.int32) if out is None else out
        out[rows], none[rows] = got.filled(0), np.ma.getmaskarray(got)
    out = np.zeros(len(lists), np.int32) if out is None else out
    if empty is not None:
        hollow = pc.equal(pc.list_value_length(lists), 0).fill_null(False).to_numpy(zero_copy_only=False)
        out[hollow], none[hollow] = empty, False
    return pa.array(out, mask=none)


def structs(lists: pa.Array, of: Callable[[np.ndarray], dict[str, np.ndarray]], kinds: str) -> pa.Array:
    """of(matrix) gives the fields of a row each, named and typed as in `kinds`."""
    fields = dict(k.split(" ") for k in kinds.split(", "))
    out, none = {k: np.zeros(len(lists), float if t == "double" else np.int64) for k, t in fields.items()}, np.ones(len(lists), bool)
    for rows, x in blocks(lists):
        none[rows] = False
        for k, a in of(x).items():
            out[k][rows] = a
    return pa.StructArray.from_arrays([pa.array(out[k], _KINDS[t]) for k, t in fields.items()], list(fields), mask=pa.array(none))


def arrays(lists: pa.Array, of: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """of(matrix) gives a matrix of the same shape; empty lists stay."""
    flat, sizes, none = [np.empty(0)], np.zeros(len(lists), np.int64), np.ones(len(lists), bool)
    order = [np.empty(0, np.int64)]
    for rows, x in blocks(lists):
        flat.append(of(x).reshape(-1))
        order.append(np.repeat(rows, x.shape[1]))
        sizes[rows], none[rows] = x.shape[1], False
    none[pc.equal(pc.list_value_length(lists), 0).fill_null(False).to_numpy(zero_copy_only=False)] = False
    values = np.concatenate(flat)[np.argsort(np.concatenate(order), kind="stable")]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(values), mask=pa.array(none))


def total(x: np.ndarray) -> np.ndarray:
    """Sums of rows, from the first cell to the last."""
    return np.cumsum(x, 1)[:, -1]


def median(x: np.ndarray) -> np.ndarray:
    n, s = x.shape[1], np.sort(x, 1)
    return (s[:, (n + 1) // 2 - 1] + s[:, n // 2]) / 2


def linear(x: np.ndarray) -> np.ndarray:
    """Linear power relative to the peak."""
    return np.power(10.0, (x - x.max(1)[:, None]) / 10)


def excess(power: np.ndarray, floor: np.ndarray) -> np.ndarray:
    return np.maximum(power - floor[:, None], 0.0)


def properties(x: np.ndarray, cols: int, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    peak, at, power = x.max(1), x.argmax(1), linear(x)
    floor = median(power)
    out = {
        "peak_db": peak,
        "headroom": -10 * np.log10(np.maximum(floor, 1e-30)),
        "peak_row": at // cols,
        "peak_col": at % cols,
        "cells_10db": (~(power <= 10.0**-1)).sum(1),  # NaN counts as above
        "cells_20db": (~(power <= 10.0**-2)).sum(1),
        "dynamic_range": peak - np.fmin.reduce(x, 1),
        "mean_db": total(x) / x.shape[1],
    }
    if {"row_centroid", "col_centroid", "row_spread", "col_spread"} & set(names):
        e, index = excess(power, floor), np.arange(x.shape[1])
        mass = np.maximum(total(e), 1e-12)
        for axis, place in (("row", (index // cols).astype(float)), ("col", (index % cols).astype(float))):
            mean = total(e * place) / mass
            out[f"{axis}_centroid"], out[f"{axis}_spread"] = mean, np.sqrt(total(e * (place - mean[:, None]) ** 2) / mass)
    return {k: out[k] for k in names}


def concentration(x: np.ndarray, share: float) -> np.ma.MaskedArray:
    """How many of the strongest cells hold `share` of the excess; masked without any."""
    power = linear(x)
    e = excess(power, median(power))
    wanted = total(e)
    reached = np.cumsum(-np.sort(-e, 1), 1)
    before = np.concatenate((np.zeros((len(e), 1)), reached[:, :-1]), 1)
    n = np.where(np.isnan(wanted), 1, (before < share * wanted[:, None]).sum(1))
    return np.ma.array(n, mask=wanted <= 0)


def above_floor(x: np.ndarray, times: float) -> np.ndarray:
    power = linear(x)
    return (~(power <= (median(power) * times)[:, None])).sum(1) / x.shape[1]


def kept(x: np.ndarray, mask_db: float | None) -> np.ndarray:
    """Which cells lie within mask_db of the peak; all without a mask."""
    return np.ones(x.shape, bool) if mask_db is None else ~(x < (x.max(1) - mask_db)[:, None])


def masked_unit(x: np.ndarray, mask_db: float | None) -> np.ndarray:
    k = kept(x, mask_db)
    mean = total(np.where(k, x, 0.0)) / np.maximum(k.sum(1), 1)
    c = np.where(k, x - mean[:, None], 0.0)
    length = np.sqrt(total(c * c))
    return c / np.where(length <= 0, 1.0, length)[:, None]


def values(lists: pa.Array) -> pa.Array:
    """The distinct values of each list and how often each occurs."""
    found, n, owner = [np.empty(0)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for rows, x in blocks(lists):
        s = np.sort(x + 0.0, 1)  # no negative zero
        first = np.concatenate((np.ones((len(s), 1), bool), ~((s[:, 1:] == s[:, :-1]) | (np.isnan(s[:, 1:]) & np.isnan(s[:, :-1])))), 1)
        places = np.flatnonzero(first)
        found.append(s.reshape(-1)[places])
        n.append(np.diff(np.append(places, s.size)))
        owner.append(rows[places // s.shape[1]])
    order = np.argsort(np.concatenate(owner), kind="stable")
    items = pa.StructArray.from_arrays([pa.array(np.concatenate(found)[order]), pa.array(np.concatenate(n)[order])], ["value", "n"])
    ends = np.cumsum(np.bincount(np.concatenate(owner), minlength=len(lists)))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), items)


_ENTRY = np.dtype([("at", "<u2"), ("x", "<f8")])


def packed(lists: pa.Array) -> pa.Array:
    """Each list as binary: its size and least value, then place and value of every other cell. Exact, and short where most cells are at the floor.

    Lists of over 65535 cells do not fit."""
    out = [None] * len(lists)
    for rows, x in blocks(lists):
        if x.shape[1] > np.iinfo(np.uint16).max:
            raise ValueError("lists of over 65535 cells are not packed")
        low = np.fmin.reduce(x, 1)
        at = np.nonzero(x != low[:, None])
        held = np.empty(len(at[0]) + len(x), _ENTRY)
        heads = np.searchsorted(at[0], np.arange(len(x))) + np.arange(len(x))
        rest = np.ones(len(held), bool)
        rest[heads] = False
        held["at"][heads], held["x"][heads] = x.shape[1], low
        held["at"][rest], held["x"][rest] = at[1], x[at]
        raw, size = held.tobytes(), _ENTRY.itemsize
        ends = np.append(heads[1:], len(held)) * size
        for row, a, b in zip(rows.tolist(), (heads * size).tolist(), ends.tolist(), strict=True):
            out[row] = raw[a:b]
    return pa.array(out, pa.binary())


def unpacked(binaries: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(cells of all, size of each) of packed lists, none of them null."""
    lengths = pc.binary_length(binaries).to_numpy(zero_copy_only=False) // _ENTRY.itemsize
    held = np.frombuffer(b"".join(binaries.to_pylist()), _ENTRY)
    heads = np.cumsum(lengths) - lengths
    sizes = held["at"][heads].astype(np.int64)
    flat = np.repeat(held["x"][heads], sizes)
    rest = np.ones(len(held), bool)
    rest[heads] = False
    flat[np.repeat(np.cumsum(sizes) - sizes, lengths)[rest] + held["at"][rest]] = held["x"][rest]
    return flat, sizes


def vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As `blocks`, of lists of doubles or of lists of packed channels, which are joined."""
    if not pa.types.is_binary(column.type.value_type):
        yield from blocks(column)
        return
    for i in range(0, len(column), STEP):
        some = column.slice(i, STEP)
        flat, sizes = unpacked(some.flatten())
        ends = np.concatenate(([0], np.cumsum(sizes)))
        cuts = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(some), 0).to_numpy())))
        for rows, x in blocks(pa.ListArray.from_arrays(pa.array(ends[cuts].astype(np.int32)), pa.array(flat))):
            yield rows + i, x
