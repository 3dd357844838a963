"""SpotSigs fingerprints: chains of content words after common words, compared by pruned Jaccard."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import settled
from quillon.llm.components import connected_components

# Anchors, the most common words of four languages.
ANCHORS = set(
    "a an and are as at be by for from in is it not of on or that the this to was with "
    "als auf das dem den der des die ein eine für im ist mit nicht sich und von zu "
    "au aux ce dans de des du en est et il la le les ne par pas pour que qui sur un une "
    "con del el en es la las lo los no para por que se su un una y".split()
)
WORD = re.compile(r"\w+")
CHAIN, DISTANCE, CACHED = 3, 1, 400_000
LOWEST = -(1 << 63)  # stands for a null id in keys


class Spots:
    """Turns texts into signature sets. The cache of words is bounded and changes nothing."""

    def __init__(self, chain: int = CHAIN, distance: int = DISTANCE):
        self.chain, self.distance = chain, distance
        self.cache: dict[str, int] = {}

    def _code(self, word: str) -> int:
        if len(self.cache) > CACHED:
            self.cache.clear()
        raw = word.encode("utf-8", "surrogatepass")
        code = self.cache[word] = (zlib.crc32(raw) << 1 | (word in ANCHORS)) & 0x1FFFFFFFF
        return code

    def signatures(self, text: str | None) -> np.ndarray:
        """The distinct signatures of a whole text, ascending 32-bit numbers.

        Each anchor starts a chain: the ``chain`` content words after it, ``distance`` content words apart.
        A text with words but no full chain has one signature, of all its words; one without has none.
        """
        get = self.cache.get
        codes = np.array([get(w) or self._code(w) for w in WORD.findall((text or "").lower())], dtype=np.uint64)
        if not len(codes):
            return np.zeros(0, dtype=np.uint32)
        anchor = codes & np.uint64(1) == 1
        content = codes[~anchor]
        last = np.cumsum(~anchor)[anchor] + self.distance * (self.chain - 1)  # the chain's last word, by content words
        fits = last < len(content)
        mix, signature = np.uint64(0x9E3779B97F4A7C15), codes[anchor][fits]
        for k in range(self.chain):
            signature = (signature * mix) ^ content[last[fits] - self.distance * (self.chain - 1 - k)]
        if not len(signature):
            return np.array([zlib.crc32(codes.tobytes())], dtype=np.uint32)
        return np.unique((signature * mix >> np.uint64(32)).astype(np.uint32))


def fingerprint(signatures: np.ndarray) -> str:
    """Eight lower-case hex digits for each signature, ascending: equal sets, equal strings."""
    return signatures.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two signature sets; 1 for two empty ones."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _dealt(docs: DataFrame, starts: list[int]) -> DataFrame:
    """The documents by block of ids, compressed; the first of each block also as the tail of the block before."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        bounds, first = np.array(starts, dtype=np.int64), set(starts)
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            packed = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
            keys = np.array([LOWEST if i is None else i for i in ids], dtype=np.int64)
            block = np.searchsorted(bounds, keys, side="right") - 1
            heads = [i for i, k in enumerate(keys.tolist()) if k in first]
            rows = np.array([*range(len(ids)), *heads], dtype=np.int64)
            tail = np.arange(len(rows)) >= len(ids)
            into = np.where(tail, (block[rows] - 1) % len(bounds), block[rows])
            yield pa.RecordBatch.from_arrays([pa.array(into.astype(np.int32)), pa.array(tail), pa.array(keys[rows]), pa.array([ids[i] for i in rows], pa.int64()), pa.array([packed[i] for i in rows], pa.binary())], names=["block", "tail", "key", "doc_id", "packed"])

    return docs.mapInArrow(run, "block int, tail boolean, key long, doc_id long, packed binary")


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document with the fingerprints of its own and its edited text: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    Next is the document with the next larger id, after the last the first; null ids come first, equal ids
    by their text's compressed bytes. Ids are cut into blocks at quantiles; the texts are dealt out once,
    compressed, and stream by in the order of their ids, two at a time. Null texts are empty; a single
    document is followed by itself; an empty table gives no rows.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    key = F.coalesce("doc_id", F.lit(LOWEST))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / (4 * parts) for k in range(1, 4 * parts)]
    found = own.agg(F.min(key), F.percentile_approx(key, F.lit(cuts), 10_000)).first()
    starts = sorted({found[0], *(found[1] or [])} - {None})
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack, spots = zstandard.ZstdDecompressor().decompress, Spots()
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        held, out = None, []  # the document whose next one is awaited: block, doc_id, text, signatures

        def close(following: str, next_set: np.ndarray) -> None:
            _, number, text, own = held
            changed = edited(text, following)
            other = spots.signatures(changed)
            out.append((number, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(own), fingerprint(other), likeness(own, other), likeness(own, next_set)))

        for batch in batches:
            for block, tail, number, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "tail", "doc_id", "packed")), strict=True):
                if tail and (held is None or held[0] != block):
                    continue  # the block's last document has met its next one already
                body = unpack(packed).decode("utf-8", "surrogatepass")
                own = spots.signatures(body)
                if held is not None and held[0] == block:
                    close(body, own)
                held = None if tail else (block, number, body, own)
                if len(out) >= 2000:
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)
                    out = []
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names=names)

    if not starts:
        return own.where("false").mapInArrow(lambda batches: iter(()), schema)
    return _dealt(own, starts).repartition("block").sortWithinPartitions("block", "tail", "key", "packed").mapInArrow(run, schema)


def prints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of every row."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = Spots()
        for batch in batches:
            found = [fingerprint(spots.signatures(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = 0.8) -> DataFrame:
    """(doc_id, component_id): documents joined by signature sets with a Jaccard of ``least`` or more.

    Equal sets are one class. Classes are partitioned by set length so that partners lie in the same or the
    next partition; each is indexed under its rarest signatures only, as many as a partner can't miss all
    of, and pairs are compared only if their lengths allow the threshold. component_id is the smallest id.
    """
    marked = settled(prints(docs, doc_id, text))
    classes = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    sets = classes.where("fingerprint <> ''").select(F.xxhash64("fingerprint").alias("cls"), F.expr("transform(sequence(0, length(fingerprint) div 8 - 1), i -> substr(fingerprint, i * 8 + 1, 8))").alias("sigs"))
    sets = settled(sets.withColumn("n", F.size("sigs")).withColumn("part", F.floor(F.log("n") / F.lit(math.log(1 / least))).cast("int")))
    each = sets.select("cls", "n", "part", F.explode("sigs").alias("sig"))
    common = each.groupBy("sig").agg(F.count("*").alias("df")).where("df > 1")  # a signature of one set joins nothing
    ranked = each.join(common, "sig").withColumn("rank", F.row_number().over(Window.partitionBy("cls").orderBy("df", "sig")))
    alone = each.join(common, "sig", "left_anti").groupBy("cls").agg(F.count("*").alias("alone"))
    kept = F.col("n") - F.ceil(F.col("n") * least) + 1 - F.coalesce("alone", F.lit(0))
    index = ranked.join(alone, "cls", "left").where(F.col("rank") <= kept).select("cls", "n", "part", "sig")
    left, right = index.alias("l"), index.withColumn("into", F.explode(F.expr("array(part, part + 1)"))).alias("r")
    pairs = left.join(right, (F.col("l.sig") == F.col("r.sig")) & (F.col("l.part") == F.col("r.into"))).where("l.cls <> r.cls and (l.part <> r.part or l.cls < r.cls)")
    pairs = pairs.where((F.least("l.n", "r.n") >= F.greatest("l.n", "r.n") * least)).select(F.col("l.cls").alias("a"), F.col("r.cls").alias("b")).distinct()
    compared = pairs.join(sets.select(F.col("cls").alias("a"), F.col("sigs").alias("x")), "a").join(sets.select(F.col("cls").alias("b"), F.col("sigs").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    links = compared.where(shared >= least * (F.size("x") + F.size("y") - shared)).select("a", "b")
    roots = connected_components(links, "a", "b")
    rooted = classes.withColumn("node", F.xxhash64("fingerprint")).join(roots, "node", "left").select("fingerprint", "first", F.coalesce("root", "node").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(rooted.join(lowest, "root").select("fingerprint", "component_id"), "fingerprint").select("doc_id", "component_id")
