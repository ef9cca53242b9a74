"""Tensors in tiles: a row holds the places and values of a block's elements as two packed arrays.

A contraction deals tiles by the tile coordinates of their shared indices and multiplies each pair of tiles in its task,
so what is shuffled follows the number of elements, not the number of products of elements or the size of tiles. Tiles
without an element have no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import prod

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ContractionError, TensorError
from ..tensor import Tensor, axes, unflatten
from .contract import labels_of, order_by_cost

#: Elements of output tiles that a task holds before it hands them on, and of tiles that it meets with one another at once.
HELD, MET = 1 << 21, 1 << 22


def tile_axes(rank: int) -> list[str]:
    return [f"t{k}" for k in range(rank)]


@dataclass(frozen=True)
class TiledTensor:
    """df has a tile coordinate t0, t1, ... for each axis, and at and x: the places in C order and the values of the tile's elements."""

    df: DataFrame
    shape: tuple[int, ...]
    tile: tuple[int, ...]

    def __post_init__(self) -> None:
        if len(self.tile) != len(self.shape) or any(n < 1 for n in self.tile):
            raise TensorError(f"tiles {self.tile} don't fit the shape {self.shape}")
        if self.df.columns != [*self.axes, "at", "x"]:
            raise TensorError(f"columns {self.df.columns} aren't those of tiles of rank {len(self.shape)}")

    @property
    def rank(self) -> int:
        return len(self.shape)

    @property
    def axes(self) -> list[str]:
        return tile_axes(self.rank)


def tiled(t: Tensor, tile: tuple[int, ...]) -> TiledTensor:
    """The tensor in tiles; elements that repeat a coordinate are added up. One shuffle of the elements by tile."""
    if len(tile) != t.rank or any(n < 1 for n in tile):
        raise TensorError(f"tiles {tile} don't fit the shape {t.shape}")
    inside = F.lit(0).cast("bigint")
    for a, n in zip(t.axes, tile):
        inside = inside * n + F.col(a) % n
    keys = [F.floor(F.col(a) / n).cast("bigint").alias(k) for a, n, k in zip(t.axes, tile, tile_axes(t.rank))]
    return TiledTensor(gathered(t.df.select(*keys, inside.cast("int").alias("at"), F.col("v").cast("double").alias("v")), t.rank), t.shape, tuple(tile))


def gathered(elements: DataFrame, rank: int) -> DataFrame:
    """Tiles of elements (t0, t1, .., at, v), which are added up where they repeat a place; zeros are left out.

    A task goes through its elements tile by tile and holds one tile and a batch.
    """
    names = tile_axes(rank)
    rows = (elements.repartition(*names) if rank else elements.coalesce(1)).sortWithinPartitions(*names, "at")

    def starts(columns: list[np.ndarray]) -> np.ndarray:
        """Where a run of equal rows begins."""
        new = np.zeros(max(0, len(columns[0]) - 1), bool)
        for c in columns:
            new |= c[1:] != c[:-1]
        return np.r_[0, 1 + np.flatnonzero(new)] if len(columns[0]) else np.zeros(0, np.int64)

    def packed(keys: list[np.ndarray], at: np.ndarray, v: np.ndarray):
        import pyarrow as pa

        some = v != 0
        keys, at, v = [k[some] for k in keys], at[some], v[some]
        first = starts(keys or [np.zeros(len(at))])
        ends = pa.array(np.r_[first, len(at)].astype(np.int32))
        return pa.RecordBatch.from_arrays([*(pa.array(k[first]) for k in keys), *(pa.ListArray.from_arrays(ends, pa.array(c)) for c in (at, v))], [*names, "at", "x"])

    def run(batches: Iterator) -> Iterator:
        rest = [*(np.zeros(0, np.int64) for _ in names), np.zeros(0, np.int32), np.zeros(0)]
        for batch in batches:
            *own, v = (np.concatenate([r, batch.column(k).to_numpy()]) for k, r in enumerate(rest))
            first = starts(own)
            if len(first):
                own, v = [c[first] for c in own], np.add.reduceat(v, first)
                last = starts(own[:-1])[-1] if rank else 0  # the last tile may go on
                if last:
                    yield packed([k[:last] for k in own[:-1]], own[-1][:last], v[:last])
                rest = [*(c[last:] for c in own), v[last:]]
        if (rest[-1] != 0).any():
            yield packed(rest[:rank], rest[rank], rest[-1])

    return rows.mapInArrow(run, ", ".join([*(f"{k} bigint" for k in names), "at array<int>", "x array<double>"]))


def untiled(t: TiledTensor) -> Tensor:
    """The elements that aren't zero."""
    rows = t.df.select(*t.axes, F.explode(F.arrays_zip("at", "x")).alias("e")).select(*t.axes, F.col("e.at").alias("at"), F.col("e.x").alias("v"))
    inside = unflatten(F.col("at"), t.tile)
    return Tensor(rows.select(*((F.col(k) * n + c).cast("bigint").alias(a) for k, n, c, a in zip(t.axes, t.tile, inside, axes(t.rank))), "v"), t.shape)


def places(index: str, of: str, tile: dict[str, int], only: list[str]) -> np.ndarray:
    """For each place in a tile of the indices `of`, what its coordinates along `only` add to a place in C order of `index`."""
    total = np.zeros([tile[c] for c in of], np.int64)
    for k, c in enumerate(index):
        if c in of and c in only:
            shape = [1] * len(of)
            shape[of.index(c)] = tile[c]
            total += (np.arange(tile[c]) * prod(tile[d] for d in index[k + 1 :])).reshape(shape)
    return total.ravel()


def pair(notation: tuple[str, str, str], a: TiledTensor, b: TiledTensor) -> TiledTensor:
    """Two operands; an index of both is summed, or kept where the output has it.

    A task gets the right tiles of a group of shared tile coordinates first, at most MET places of them, and goes through the
    left ones; right tiles beyond that, and left ones of few groups, are dealt over more groups. Sums of a task are elements.
    """
    p, q, out = notation
    sizes = {c: n for x, t in ((p, a), (q, b)) for c, n in zip(x, t.shape)}
    tiles = dict(zip(p, a.tile))
    if any(tiles.setdefault(c, n) != n for c, n in zip(q, b.tile)):
        raise ContractionError("shared indices must be cut into tiles of one size")
    shared, new = [c for c in p if c in q], [c for c in q if c not in p]
    ways = {c: -(-sizes[c] // tiles[c]) for c in sizes}
    parts = int(a.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lefts = max(1, parts // prod(ways[c] for c in shared))
    rights = max(1, -(-prod(ways[c] for c in new) * prod(b.tile) // MET))
    some = lambda names, n: F.pmod(F.xxhash64(*names), F.lit(n)).cast("int") if names else F.lit(0)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    none = F.lit(None).cast("bigint")
    left = a.df.select(*a.axes, "at", "x", some(a.axes, lefts).alias("l"), every(rights).alias("r"))
    right = b.df.select(*b.axes, "at", "x", every(lefts).alias("l"), some([k for k, c in zip(b.axes, q) if c in new], rights).alias("r"))
    group = [f"s_{c}" for c in shared] + ["l", "r"]

    def rows(df: DataFrame, names: list[str], letters: str, side: int) -> DataFrame:
        own = dict(zip(letters, names))
        return df.select(*(F.col(own[c]).alias(f"s_{c}") for c in shared), "l", "r", F.lit(side).alias("side"), *((F.col(own[c]) if c in own else none).alias(f"o_{c}") for c in out), "at", "x")

    both = rows(right, b.axes, q, 0).unionByName(rows(left, a.axes, p, 1)).repartition(*group).sortWithinPartitions(*group, "side")
    width, rank, size = len(group), len(out), prod(tiles[c] for c in out)
    ours = [k for k, c in enumerate(out) if c in p]
    meets = "".join(shared)
    to_p, to_q = places(out, p, tiles, list(p)), places(out, q, tiles, new)
    meet_p, meet_q = (places("".join(shared), x, tiles, shared) for x in (p, q))

    def multiply(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: dict[tuple, np.ndarray] = {}

        def handed() -> Iterator:
            at = [np.flatnonzero(total) for total in held.values()]
            keys = [np.repeat(np.array([key[k] for key in held], np.int64), list(map(len, at))) for k in range(rank)]
            if held:
                yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate([t[i] for t, i in zip(held.values(), at)]))], [*tile_axes(rank), "at", "v"])
            held.clear()

        now, found = None, []
        for batch in batches:
            names = [batch.column(k).to_pylist() for k in range(width + 1 + rank)]
            ats, xs = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            for row in range(batch.num_rows):
                key = tuple(n[row] for n in names[:width])
                if key != now:
                    now, found = key, []
                at, x = (c.slice(row, 1).flatten().to_numpy() for c in (ats, xs))
                at_out = [n[row] for n in names[width + 1 :]]
                if names[width][row] == 0:  # sorted by what meets, and the runs of it
                    order = np.argsort(meet_q[at], kind="stable")
                    found.append((at_out, meet_q[at][order], to_q[at][order], x[order]))
                    continue
                where, base = meet_p[at], to_p[at]
                for other, meet, to, y in found:
                    lo, hi = np.searchsorted(meet, where, "left"), np.searchsorted(meet, where, "right")
                    n = hi - lo
                    if not n.any():
                        continue
                    own = tuple(at_out[k] if k in ours else other[k] for k in range(rank))
                    total = held.get(own)
                    if total is None:
                        if held and (len(held) + 1) * size > HELD:
                            yield from handed()
                        total = held[own] = np.zeros(size)
                    ends = np.cumsum(n)
                    for part in np.split(np.arange(len(n)), np.searchsorted(ends, np.arange(MET, ends[-1], MET))):
                        few = n[part]
                        met = np.repeat(lo[part] - np.cumsum(few) + few, few) + np.arange(few.sum())
                        np.add.at(total, np.repeat(base[part], few) + to[met], np.repeat(x[part], few) * y[met])
        yield from handed()

    schema = ", ".join([*(f"{k} bigint" for k in tile_axes(rank)), "at int", "v double"])
    return TiledTensor(gathered(both.mapInArrow(multiply, schema), rank), tuple(sizes[c] for c in out), tuple(tiles[c] for c in out))


def einsum(notation: str, *tensors: TiledTensor) -> TiledTensor:
    """Two operands or more, pair by pair in the cheapest order; an index that is summed must be in two operands or more.

    An index has tiles of one size in all operands. Absent tiles are zero; tensors without tiles give none.
    """
    parts, out = labels_of(notation, list(tensors))
    if len(parts) < 2 or any(len(set(p)) != len(p) for p in parts):
        raise ContractionError("two operands or more, none of which repeats an index")
    sizes = {c: n for p, t in zip(parts, tensors) for c, n in zip(p, t.shape)}
    for c in sizes:
        if c not in out and sum(c in p for p in parts) < 2:
            raise ContractionError(f"index {c} is in one operand and not in the output")
    have = {k: (p, t) for k, (p, t) in enumerate(zip(parts, tensors))}
    for a, b, to in order_by_cost(parts, out, sizes):
        (p, x), (q, y) = have.pop(a), have.pop(b)
        later = set(out).union(*(r for r, _ in have.values()))
        keep = "".join(c for c in dict.fromkeys(p + q) if c in later)
        if not have:
            keep = out
        have[to] = keep, pair((p, q, keep), x, y)
    ((_, result),) = have.values()
    return result
