"""Embedding near-duplicates: E8 lattice cells in several tables, neighbouring cells probed, cosine verified."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import scratch, settled
from quillon.llm.components import connected_components

BLOCKS, PROBES, SCALE, SEED = 2, 4, 1.4, 11
BASE, MISSED = 10_000, 0.02  # vectors up to which ``SCALE`` holds; share of pairs at the least cosine that may never meet
CHUNK = 1024  # members of a cell compared at a time; larger cells are dealt out as pairs of chunks


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: what leads from a cell to its nearest neighbours."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(pairs + halves)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """The nearest point of D8: integers of even sum. Where the sum is odd, the worst coordinate goes the other way."""
    point = np.rint(x)
    odd = np.flatnonzero(point.sum(axis=1) % 2)
    off = x[odd] - point[odd]
    worst = np.abs(off).argmax(axis=1)
    point[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return point


def nearest_point(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is D8 and D8 moved by a half."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1))[:, None], whole, half)


class Tables:
    """Random projections for vectors of one length, and the keys of cells in them."""

    def __init__(self, length: int, tables: int, scale: float = SCALE, blocks: int = BLOCKS, probes: int = PROBES, seed: int = SEED):
        self.tables, self.blocks, self.probes = tables, blocks, probes
        rng = np.random.default_rng([seed, length])
        self.projections = rng.normal(size=(tables, blocks, length, 8)) * (scale / np.sqrt(8))
        self.roots = roots()
        self.salts = rng.integers(1, 1 << 62, size=(tables, blocks, 8), dtype=np.int64) | 1
        self.bases = rng.integers(1, 1 << 62, size=tables, dtype=np.int64)

    def cell(self, unit: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(home, probes) in one table: for each row the key of its cell, and those of the nearest cells one step away."""
        key, gains, moves = np.full(len(unit), self.bases[t]), [], []
        for b in range(self.blocks):
            x = unit @ self.projections[t, b]
            point = nearest_point(x)
            key = key + (np.rint(2 * point).astype(np.int64) * self.salts[t, b]).sum(axis=1)  # wraps around
            gains.append((x - point) @ self.roots.T)
            moves.append((np.rint(2 * self.roots).astype(np.int64) * self.salts[t, b]).sum(axis=1))
        best = np.argpartition(-np.concatenate(gains, axis=1), self.probes, axis=1)[:, : self.probes]  # the best, in any order
        return key, key[:, None] + np.concatenate(moves)[best]

    def cells(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(homes, probes) in all tables."""
        each = [self.cell(unit, t) for t in range(self.tables)]
        return np.stack([home for home, _ in each], axis=1), np.stack([around for _, around in each], axis=1)


def shape(length: int, vectors: int, least: float, trials: int = 400) -> tuple[int, float]:
    """(tables, scale) for vectors of one length.

    The lattice gets finer with the number of vectors, so that a cell holds as many that met by chance whatever
    that number; and there are as many tables as leave ``MISSED`` of the pairs at the least cosine
    unmet, which is measured on random pairs.
    """
    scale = SCALE * (max(vectors, BASE) / BASE) ** (1 / (8 * BLOCKS))
    rng = np.random.default_rng([SEED, length])
    x, y = (rng.normal(size=(trials, length)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)
    cosine = min(max(least, 0.0), 1.0)
    tried = Tables(length, 8, scale, seed=SEED + 1)
    (hx, ax), (hy, ay) = tried.cells(x), tried.cells(cosine * x + np.sqrt(1 - cosine**2) * y)
    met = float(((hx == hy) | (ax == hy[:, :, None]).any(axis=2) | (ay == hx[:, :, None]).any(axis=2)).mean())
    return max(4, math.ceil(math.log(MISSED) / math.log(1 - min(max(met, 1 / trials), 0.99)))), scale


def units(values: list[bytes], kind: str) -> np.ndarray:
    rows = np.array([np.frombuffer(v, dtype=kind) for v in values], dtype=np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v); v is null where a vector can't be compared: null, empty, zero, or with null or non-finite parts. Floats
    stay floats, four bytes each until they are compared as doubles; other numbers become doubles."""
    v = F.col(embedding) if vectors.schema[embedding].dataType.simpleString() == "array<float>" else F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(vec_id).alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)) & F.col(vec_id).isNotNull(), v).alias("v"))


def _kind(frame: DataFrame) -> str:
    return "<f4" if frame.schema["v"].dataType.simpleString() == "array<float>" else "<f8"


def _in_cells(classes: DataFrame, shapes: dict[int, tuple[int, float]]) -> DataFrame:
    """(cid, cell, home, t) for each class, table and cell, its own and the probed ones, where classes meet: the cell has two of
    them, one at home. Ids travel, no vectors; most rows meet nobody and go no further."""
    kind = _kind(classes)
    width = np.dtype(kind).itemsize

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Tables] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                raw = [np.asarray(x, dtype=kind).tobytes() for x in batch.column("v").to_pylist()]
                lengths, cid = np.array([len(r) // width for r in raw]), np.asarray(batch.column("cid"))
                for length in np.unique(lengths).tolist():
                    own = np.flatnonzero(lengths == length)
                    if length not in tables:
                        tables[length] = Tables(length, *shapes[length])
                    homes, around = tables[length].cells(units([raw[i] for i in own], kind))
                    found = np.concatenate([homes[:, :, None], around], axis=2)
                    home = np.zeros(found.shape, dtype=bool)
                    home[:, :, 0] = True
                    table = np.broadcast_to(np.arange(found.shape[1], dtype=np.int32)[None, :, None], found.shape)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cid[own], found[0].size)), pa.array(found.reshape(-1)), pa.array(home.reshape(-1)), pa.array(table.reshape(-1))], names=["cid", "cell", "home", "t"])

    def meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_at, alive, first = None, False, None  # the cell that goes on, whether somebody is at home, its first row until it is given
        for batch in batches:
            cell, cid, home, table = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "cid", "home", "t"))
            if not len(cell):
                continue
            starts = np.concatenate([[cell_at is None or cell[0] != cell_at], cell[1:] != cell[:-1]])
            group = np.cumsum(starts)  # 0 is the cell that goes on
            lives = np.concatenate([[alive], home[starts]])[group]  # those at home come first
            later = ~starts & lives
            leads = starts & lives & np.concatenate([~starts[1:], [False]])
            given = later | leads
            out = [x[given] for x in (cid, cell, home, table)]
            if first is not None and later[0]:
                out = [np.concatenate([[x], y]) for x, y in zip(first, out, strict=True)]
            if starts.any():
                first = (cid[-1], cell[-1], home[-1], table[-1]) if starts[-1] and lives[-1] else None
            elif later[0]:
                first = None
            cell_at, alive = cell[-1], bool(lives[-1])
            yield pa.RecordBatch.from_arrays([pa.array(out[0].astype("i8")), pa.array(out[1].astype("i8")), pa.array(out[2].astype(bool)), pa.array(out[3].astype("i4"))], names=["cid", "cell", "home", "t"])

    schema = "cid long, cell long, home boolean, t int"
    return classes.select("cid", "v").mapInArrow(keys, schema).repartition("cell").sortWithinPartitions("cell", F.desc("home"), "cid").mapInArrow(meeting, schema)


def _verified(cid: np.ndarray, values: list[bytes], home: np.ndarray, part: np.ndarray, cell: int, table: int, least: float, tables: Tables, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Indexes (a, b) of the pairs to be counted here: cosine of ``least`` or more, of different parts where there
    are two, one of them at home in the cell, and this the first cell of the first table where the two meet.

    Earlier tables are looked at one after the other; most pairs have met in the first, so few rows go on.
    """
    unit = units(values, kind)
    near = unit @ unit.T >= least
    near &= (home[:, None] | home[None]) & (cid[:, None] < cid[None])
    if part.min() != part.max():
        near &= part[:, None] != part[None]
    a, b = np.nonzero(near)
    for t in range(table + 1):
        if not len(a):
            break
        some, back = np.unique(np.concatenate([a, b]), return_inverse=True)
        homes, around = tables.cell(unit[some], t)
        x, y = back[: len(a)], back[len(a) :]
        to_x, to_y = homes[x] == homes[y], np.zeros(len(a), dtype=bool)
        for k in range(tables.probes):
            to_x |= around[y, k] == homes[x]
            to_y |= around[x, k] == homes[y]
        if t < table:
            kept = ~(to_x | to_y)
        else:
            kept = np.where(to_x, homes[x], homes[y]) == cell
        a, b = a[kept], b[kept]
    return a, b


def _hubs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n can reach over the pairs."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _compared(dealt: DataFrame, least: float, kind: str, shapes: dict[int, tuple[int, float]]) -> DataFrame:
    """(cid, hub, links): for rows sorted by cell and pair of chunks, how many vectors each class links to there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, Tables] = {}
        key, held, out = None, [], []

        def close() -> None:
            if len(held) < 2:
                return
            by_size: dict[int, list] = {}
            for row in held:
                by_size.setdefault(len(row[2]), []).append(row)
            for size, rows in by_size.items():
                home = np.array([r[3] for r in rows])
                if len(rows) < 2 or not home.any():
                    continue
                cid, n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
                if size not in tables:
                    length = size // np.dtype(kind).itemsize
                    tables[size] = Tables(length, *shapes[length])
                a, b = _verified(cid, [r[2] for r in rows], home, np.array([r[4] for r in rows]), key[0], rows[0][5], least, tables[size], kind)
                if len(a):
                    links = np.bincount(a, weights=n[b], minlength=len(rows)) + np.bincount(b, weights=n[a], minlength=len(rows))
                    hub = cid[_hubs(len(rows), a, b)]
                    out.extend((cid[i], hub[i], int(links[i])) for i in np.flatnonzero(links))

        for batch in batches:
            for cell, i, j, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "i", "j", "cid", "n", "v", "home", "part", "t")), strict=True):
                row[2] = np.asarray(row[2], dtype=kind).tobytes()
                if (cell, i, j) != key:
                    close()
                    key, held = (cell, i, j), []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], names=["cid", "hub", "links"])
            out = []
        close()
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in range(3)], names=["cid", "hub", "links"])

    return dealt.mapInArrow(run, "cid long, hub long, links long")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", least: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    Equal vectors are one class, so copies are never compared. Each class goes to its cell and the four
    nearest cells of several tables; how fine these are and how many follows from the number of classes, see
    ``shape``. Classes that meet, one of them at home, are compared in double precision inside the cell, and
    each pair counts only where it meets first, so that no pairs are made as rows. Vectors travel only to
    cells where somebody meets. A cell of more than ``CHUNK`` members is dealt out as pairs of chunks, which
    keeps memory bounded and loses nothing. At the least cosine about 98 % of all pairs meet, from 0.95 on
    practically all.

    Vectors that are null, empty, zero or have null or non-finite parts, and rows with a null id, link with
    nothing: n_links 0, themselves as component. Vectors of different lengths never link. Repeated rows link
    with each other. An id is taken to name one vector; an empty table gives no rows.
    """
    rows = settled(usable(vectors, vec_id, embedding))
    classes = settled(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").cast("long").alias("cid"), F.count("*").alias("n")))
    sizes = classes.groupBy(F.size("v").alias("length")).count().collect()  # a row for each length of vectors
    shapes = {r["length"]: shape(r["length"], r["count"], least) for r in sizes}
    with scratch() as keep:
        cells = keep(_in_cells(classes, shapes), "cells")
        hot = cells.groupBy("cell").agg(F.count("*").alias("members")).where(F.col("members") > CHUNK).select("cell", F.ceil(F.col("members") / CHUNK).cast("int").alias("chunks"))
        chunked = cells.join(hot, "cell", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        chunked = chunked.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
        met = chunked.select("cell", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "cid", "home", "part", "t")
        dealt = met.join(classes, "cid").select("cell", "i", "j", "cid", "n", "v", "home", "part", "t")
        found = settled(_compared(dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j"), least, _kind(rows), shapes))
    degrees = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("cid <> hub"), "cid", "hub").select(F.col("node").alias("cid"), "root")
    settled_classes = classes.join(degrees, "cid", "left").join(roots, "cid", "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("root", "cid").alias("root"))
    out = rows.join(settled_classes, "v", "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
