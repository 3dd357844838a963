"""Near duplicates by word shingles: all texts whose sets of shingles have a Jaccard of 0.8 or more, found exactly."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import BROADCAST_ROWS, lean, listed, small_batches

SEED, SHINGLE = 42, 5
SPACE = re.compile(rb"[\x20\x09-\x0D]")
LEAST = (4, 5)  # the least Jaccard, as a fraction so that no rounding decides
LOWEST = -(1 << 63)  # stands for a null id in keys
ORDER_SHARE, ORDER_HITS, ORDER_SIZE = 32, 3, 50_000  # which shingles are ranked as common; they only order, and change no result
SEEN = 200_000  # texts that a task remembers; bounds memory, changes nothing
PIECE = 1 << 20  # bytes of a text that are hashed at a time

_IS_SPACE = np.array([c == 0x20 or 0x09 <= c <= 0x0D for c in range(256)])
_BYTE = np.array([xxhash.xxh64_intdigest(bytes([c]), SEED) for c in range(256)], dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C13  # odd, so that it has an inverse modulo 2 ** 64
_POWERS: list[np.ndarray] = []


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the base and of its inverse, ``size`` or more of each; kept by the worker, ``PIECE`` or a word's length."""
    if not _POWERS or len(_POWERS[0]) < size:
        size = max(size, 1 << 14, min(2 * size, PIECE))
        _POWERS[:] = [np.cumprod(np.array([1, *[base] * size], dtype=np.uint64)) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def pieces(raw: bytes) -> Iterator[bytes]:
    """``raw`` cut behind spaces, after ``PIECE`` bytes each; a piece without a space goes on."""
    start = 0
    while len(raw) - start > PIECE and (space := SPACE.search(raw, start + PIECE)):
        yield raw[start : space.end()]
        start = space.end()
    yield raw[start:]


def word_codes(text: str | None) -> np.ndarray:
    """A 64-bit number for each word of a whole text; words are split at ASCII white space, with A-Z lowered.

    A word's number is a polynomial of its bytes modulo 2 ** 64, read off running sums of the whole piece.
    """
    found = [np.zeros(0, dtype=np.uint64)]
    for piece in pieces((text or "").encode("utf-8", "surrogatepass").lower()):
        raw = np.frombuffer(piece, dtype=np.uint8)
        space = np.ones(len(raw) + 2, dtype=bool)
        space[1:-1] = _IS_SPACE[raw]
        edges = np.flatnonzero(space[1:] != space[:-1])
        starts, ends = edges[::2], edges[1::2]
        power, inverse = _powers(len(raw))
        sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[raw] * power[: len(raw)], out=sums[1:])
        found.append((sums[ends] - sums[starts]) * inverse[starts])
    return np.concatenate(found) if len(found) > 2 else found[-1]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of the word shingles of a whole text, ascending.

    Fewer words than a shingle has make one shingle; no word (null and empty texts too) makes none.
    """
    codes = word_codes(text)
    if not len(codes):
        return np.zeros(0, dtype=np.int64)
    k = min(size, len(codes))
    many = len(codes) - k + 1
    hashes = np.full(many, k, dtype=np.uint64)
    for i in range(k):  # the order of the words counts
        hashes ^= codes[i : many + i]
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(32)
    hashes = np.sort(hashes.view(np.int64))
    return hashes[np.concatenate([[True], hashes[1:] != hashes[:-1]])]


def fingerprint(grams: np.ndarray) -> int:
    """Equal sets, equal numbers; a signed integer."""
    return int.from_bytes(xxhash.xxh64_digest(grams.tobytes(), SEED), "big", signed=True)


def simhash_of(grams: np.ndarray) -> int:
    """The SimHash of a set of shingles: a bit is 1 if it is set in over half of them; none makes zero."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(grams), 50_000):
        ones += np.unpackbits(grams[at : at + 50_000].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big", signed=True)


def prefix(grams: np.ndarray, common: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The first shingles of a set, as many as a partner can't miss all of: rare ones first, then by their hits.

    ``common`` is ascending. Any order that all sets share gives the same pairs.
    """
    many = len(grams) - (LEAST[0] * len(grams) + LEAST[1] - 1) // LEAST[1] + 1 if len(grams) else 0
    if len(common) and len(grams):
        at = np.minimum(np.searchsorted(common, grams), len(common) - 1)
        grams = grams[np.argsort(np.where(common[at] == grams, hits[at], 0), kind="stable")]
    return grams[:many]


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *found])))


def _common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, hits), ascending by shingle, of the most common shingles in one of ``ORDER_SHARE`` different texts."""
    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(ORDER_SHARE)) == 0)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *found]))], names=["gram"])

    counted = small_batches(some).mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("hits")).where(F.col("hits") >= ORDER_HITS)
    rows = sorted((r["gram"], r["hits"]) for r in counted.orderBy(F.desc("hits"), "gram").limit(ORDER_SIZE).collect())
    found = np.array(rows, dtype=np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def marked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, n, sim, prefix) of every row: the fingerprint of its set, the set's size, SimHash and prefix.

    A task leaves out the prefix (null) where it has just given it for the same set.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(_common(own))  # ORDER_SIZE rows at most

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, hits = shared.value
        seen: set[int] = set()
        for batch in batches:
            sets = [shingles(t) for t in batch.column("text").to_pylist()]
            prints, firsts, valid = [fingerprint(s) for s in sets], [], []
            for fp, s in zip(prints, sets, strict=True):
                valid.append(fp not in seen)
                firsts.append(prefix(s, common, hits) if valid[-1] else s[:0])
                if len(seen) < SEEN:
                    seen.add(fp)
            lists = pc.if_else(pa.array(valid), _lists(firsts), pa.scalar(None, pa.list_(pa.int64())))
            numbers = [pa.array(x, pa.int64()) for x in (prints, list(map(len, sets)), [simhash_of(s) for s in sets])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *numbers, lists], names=["doc_id", "fp", "n", "sim", "prefix"])

    return small_batches(own).mapInArrow(run, "doc_id long, fp long, n long, sim long, prefix array<long>")


def cells(prints: DataFrame) -> DataFrame:
    """(gram, fp, n, at): the prefix shingles that different sets share, with these sets, their sizes and the
    shingle's place in the set's order, from 1.

    All shingles are dealt out once, 24 bytes each, and stream by in order; most belong to one set and go no
    further. No task holds the sets of a shingle.
    """
    rows = prints.where("prefix is not null").select("fp", "n", F.posexplode("prefix").alias("at", "gram")).select("gram", "fp", F.expr("shiftleft(n, 24) + at + 1").alias("place"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int, int] | None = None  # the first row of the shingle at the end of the batch before, until it is given
        gram_at, fp_at = None, None  # the last row that came by
        for batch in batches:
            gram, fp, place = (np.asarray(batch.column(c)) for c in ("gram", "fp", "place"))
            if not len(gram):
                continue
            same_gram = np.concatenate([[gram_at is not None and gram[0] == gram_at], gram[1:] == gram[:-1]])
            again = same_gram & np.concatenate([[fp_at is not None and fp[0] == fp_at], fp[1:] == fp[:-1]])
            gram_at, fp_at = gram[-1], fp[-1]
            gram, fp, place, more = gram[~again], fp[~again], place[~again], same_gram[~again]
            if not len(gram):
                continue
            given = more | np.concatenate([more[1:], [False]])  # a shingle's first row, with another after it, and what follows
            out = [x[given] for x in (gram, fp, place)]
            if last is not None and more[0]:
                out = [np.concatenate([[y], x]) for x, y in zip(out, last, strict=True)]
            last = None if more[-1] else (gram[-1], fp[-1], place[-1])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (out[0], out[1], out[2] >> 24, out[2] & 0xFFFFFF)], names=["gram", "fp", "n", "at"])

    return rows.repartition("gram").sortWithinPartitions("gram", "fp").mapInArrow(run, "gram long, fp long, n long, at long")


def _least(n: str, m: str) -> str:
    """The least number of shingles that sets of n and m have in common from the ``LEAST`` share on."""
    return f"({LEAST[0]} * ({n} + {m}) + {sum(LEAST) - 1}) div {sum(LEAST)}"


def apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(gram, fp, n, at, root): the cells whose sets are in different components still; ``roots`` is (node, root)."""
    placed = met.select("gram", "fp", "n", "at").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return _several(placed)


def _several(placed: DataFrame) -> DataFrame:
    several = placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("gram")
    return placed.join(several, "gram", "left_semi").select("gram", "fp", "n", "at", "root")


def _to_come(still: DataFrame) -> DataFrame:
    """``still`` with ``come``, the cells that a set has from this one on, and ``rest``, its shingles behind its prefix."""
    come = F.row_number().over(Window.partitionBy("fp").orderBy(F.desc("at")))
    return still.withColumn("come", come).withColumn("rest", F.expr(f"({LEAST[0]} * n + {LEAST[1] - 1}) div {LEAST[1]} - 1"))


def hub_pairs(still: DataFrame, seeds: range) -> DataFrame:
    """(a, b): each set of a cell with one hub of the cell for each seed, if that is in another component.

    The hub of seed 0 has the least share of rarer shingles: of near copies one with few edits, which has the
    highest Jaccard to the others. Those of other seeds are drawn.
    """
    order = lambda t: F.xxhash64("fp", F.lit(t)).cast("double") if t else F.col("at") / F.col("n")
    hub = lambda t: F.min(F.struct(order(t).alias("h"), *_as_other())).alias(f"h{t}")
    still = _to_come(still)
    hubs = still.groupBy("gram").agg(*[hub(t) for t in seeds])
    each = still.join(hubs, "gram").select(*still.columns, F.explode(F.array(*[f"h{t}" for t in seeds])).alias("s")).select("*", "s.*").drop("s")
    return _distinct(each)


def all_pairs(still: DataFrame) -> DataFrame:
    """(a, b): the pairs of a cell's sets that are in different components.

    One of the two is outside the cell's main component, that with the most sets, so only those outside meet all
    sets of the cell: a large group that is joined up is not compared with itself. A set is in the cells alone
    that can be the first that it shares with another one: an edited copy whose own shingles are too many in none.
    """
    rows = _firsts(still)
    main = rows.groupBy("gram", "root").agg(F.count("*").alias("many")).groupBy("gram").agg(F.max_by("root", "many").alias("main"))
    outside = rows.join(main, "gram").where("root <> main").drop("main")
    return _distinct(outside.join(rows.select("gram", *_as_other()), "gram"))


def _firsts(still: DataFrame) -> DataFrame:
    """The rows of ``_to_come`` whose shingle can be the first that the set has in common with one of least Jaccard to it.

    This is ``_distinct``'s bound for the sizes that the cell holds. Without its roundings the bound is concave in the other
    size, so that the least and the greatest size decide.
    """
    rows, (top, low) = _to_come(still), LEAST
    sizes = rows.groupBy("gram").agg(F.min("n").alias("m"), F.max("n").alias("o"))
    ends = F.array(F.expr(f"greatest(m, ({top} * n + {low - 1}) div {low})"), F.expr(f"least(o, ({low} * n) div {top})"))
    share = lambda m: top * (F.col("n") + m)
    held = F.exists(ends, lambda m: (top + low) * (F.col("n") - F.col("at") + 1) >= share(m))
    shared = F.exists(ends, lambda m: low * ((top + low) * F.col("come") - share(m)) + (top + low) * F.greatest(low * F.col("rest"), top * m - 1) >= 0)
    return rows.join(sizes, "gram").where(held & shared).select(rows.columns)


def _as_other() -> list[Column]:
    return [F.col(c).alias(k) for c, k in (("fp", "hub"), ("n", "m"), ("at", "there"), ("root", "of"), ("come", "comes"), ("rest", "rests"))]


def _distinct(met: DataFrame) -> DataFrame:
    """The pairs that can have the least Jaccard; one that has it can on the first shingle that the two share.

    From there on each set holds all that they share. And both prefixes hold the first of these shingles, all
    but as many as stand behind one of the prefixes at most; each of them is a cell that both sets have.
    """
    o = F.expr(_least("n", "m"))
    likely = (F.least(F.col("n") - F.col("at"), F.col("m") - F.col("there")) + 1 >= o) & (F.least("come", "comes") + F.greatest("rest", "rests") >= o)
    return met.where((F.col("root") != F.col("of")) & likely).select(F.least("fp", "hub").alias("a"), F.greatest("fp", "hub").alias("b")).distinct()


def sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(fp, grams): the whole sets of the classes in ``wanted`` (fp, first), made again from one text of each.

    Up to ``BROADCAST_ROWS`` ids pick the texts before they are read by Python; more are joined to the sets.
    """
    picked = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)).alias("first"), F.col(text).cast("string").alias("text"))
    wanted = wanted.select("fp", F.coalesce("first", F.lit(LOWEST)).alias("first"))
    if wanted.count() <= BROADCAST_ROWS:
        picked, wanted = picked.join(F.broadcast(wanted.select("first")), "first", "left_semi"), F.broadcast(wanted)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("first"), pa.array([fingerprint(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["first", "fp", "grams"])

    made = small_batches(picked).mapInArrow(run, "first long, fp long, grams binary")
    return made.join(wanted, ["fp", "first"], "left_semi").select("fp", "grams").dropDuplicates(["fp"])


def possible(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose prefixes share enough; the others can't have the least Jaccard.

    Sets of n and m shingles with ``o`` in common share at least l of their first n - o + l and m - o + l.
    """
    named = listed(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
    firsts = prints.where("prefix is not null").select("fp", "n", "prefix").join(named, "fp", "left_semi").dropDuplicates(["fp"])
    left, right = (firsts.select(F.col("fp").alias(k), F.col("n").alias(f"n{k}"), F.col("prefix").alias(f"p{k}")) for k in "ab")
    both = pairs.join(left, "a").join(right, "b")
    least = F.least(F.size("pa") - F.col("na"), F.size("pb") - F.col("nb")) + F.expr(_least("na", "nb"))
    return both.where(F.size(F.array_intersect("pa", "pb")) >= least).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) of ``pairs`` whose whole sets have the least Jaccard."""
    both = pairs.join(sets.select(F.col("fp").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("fp").alias("b"), F.col("grams").alias("y")), "b")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                shared = len(np.intersect1d(np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64), assume_unique=True))
                near.append(shared * sum(LEAST) * 8 >= (len(x) + len(y)) * LEAST[0])
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return small_batches(both).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
