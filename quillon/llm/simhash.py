"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import shingles
from quillon.llm.common import BROADCAST_ROWS, fresh, lean, looked_up, scratch, settled, small_batches
from quillon.llm.components import connected_components

SEED, BITS = 42, 64
LOWEST = -(1 << 63)  # stands for a null id in keys


def simhash(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text, as a signed integer.

    A bit is 1 if it is set in over half the XXH64 of the word shingles, repeats included. Fewer words than
    a shingle has make one shingle; no word (null and empty texts too) makes zero. A long text is counted
    piece by piece.
    """
    raw = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes: A-Z and ASCII white space alone
    ones, many, words, digest = np.zeros(BITS, dtype=np.int64), 0, [], xxhash.xxh64_digest
    for piece in shingles.pieces(raw):
        words += piece.split()
        if len(words) < shingle:
            continue
        hashes = _hashed(words, shingle, digest)
        ones += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        many += len(words) - shingle + 1
        words = words[len(words) - shingle + 1 :]
    if not many:
        return int.from_bytes(digest(b" ".join(words), SEED), "big", signed=True) if words else 0
    return int.from_bytes(np.packbits(2 * ones > many).tobytes(), "big", signed=True)


def _hashed(words: list[bytes], shingle: int, digest) -> bytes:
    joined = b" ".join(words)
    starts = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum([len(w) + 1 for w in words], out=starts[1:])
    return b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (starts[shingle:] - 1).tolist(), strict=True)])


def _simhash_column(shingle: int):
    @F.pandas_udf("long")
    @lean
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([simhash(x, shingle) for x in batch], dtype="int64")

    return of


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = 3) -> DataFrame:
    """``docs`` with the long fingerprint of its text in place of the text."""
    return small_batches(docs).select(*[c for c in docs.columns if c != text], _simhash_column(shingle)(F.col(text)).alias(name))


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def _masks(flips: int) -> list[int]:
    """Every choice of that many bits, as signed 64-bit integers."""
    return [_signed(sum(1 << b for b in c)) for c in combinations(range(BITS), flips)]


def _with_company(prints: DataFrame, mask: int) -> DataFrame:
    """The fingerprints that may have another one within 3 bits; those left out have none.

    Of 3 differing bits at most one lies in one of two halves, the bits of ``mask`` and the others. Halves
    that differ in one bit have different parities: an even half emits itself, an odd one itself and its 32
    neighbours. A cell counts if it has two fingerprints and, unless all of them lie on it, an even one on it.
    """

    def cells(mask: int) -> DataFrame:
        flips = [1 << b for b in range(BITS) if mask >> b & 1]
        half = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        flip = F.when(F.bit_count(half) % 2 == 1, F.lit([0, *map(_signed, flips)])).otherwise(F.lit([0]))
        return prints.select("fp", half.alias("half"), F.explode(flip).alias("m")).select("fp", F.col("half").bitwiseXOR(F.col("m")).alias("cell"), (F.col("m") == 0).alias("own"))

    both = cells(mask).unionByName(cells(~mask & (1 << BITS) - 1)).repartition("cell")  # dealt out once, read twice
    lowest, highest = (f(F.when(F.col("own"), F.col("fp"))) for f in (F.min, F.max))
    met = both.groupBy("cell").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), lowest.alias("a"), highest.alias("b"))
    met = met.where((F.col("low") != F.col("high")) & F.when(F.bit_count("cell") % 2 == 1, F.col("a") != F.col("b")).otherwise(F.col("a").isNotNull()))
    return both.join(met.select("cell"), "cell", "left_semi").select("fp").distinct()


def ball_links(prints: DataFrame) -> DataFrame:
    """(a, b): links that join up all fingerprints (column ``fp``, distinct) with 3 or fewer differing bits.

    Each fingerprint emits the keys of even parity in its ball: an even one itself and all keys two flips
    away, an odd one all keys one flip away. Two fingerprints within 3 bits share a key, on which one of
    them is the key itself or one flip away, since an even and an odd one meet at 2 + 1 or 0 + 1 flips, two
    odd ones at 1 + 1 and two even ones at 0 + 2. On a key those nearer ones are within 2 bits of each other
    and within 3 of all others, so each is verified by its flips alone and a link to the smallest of the
    nearer ones is enough: no pairs are made. A key holds 2,081 fingerprints at most.
    """
    for mask in (0xFFFFFFFF, 0x5555555555555555):  # the second division finds out most chance meetings of the first
        prints = _with_company(prints, mask)
    prints = settled(prints)
    parity = F.bit_count("fp") % 2
    even, odd = prints.where(parity == 0), prints.where(parity == 1)

    def keys(of: DataFrame, masks: list[int]) -> DataFrame:
        return of.select("fp", F.explode(F.lit(masks)).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("key"))

    near = even.select("fp", F.col("fp").alias("key")).unionByName(keys(odd, _masks(1)))
    far = keys(even, _masks(2))
    hub = near.groupBy("key").agg(F.min("fp").alias("hub"))
    return near.unionByName(far).join(hub, "key").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``; component_id is the smallest id reachable over links.

    Exact copies share a fingerprint and are put together before any key is made. Null and empty texts have
    fingerprint zero and link like any other. Rows with a null id take part, and get a component; where all
    of it have null ids the component is null. Repeated rows stay rows. An empty table gives no rows. Other
    columns are ignored, whatever their names. A text of any length is hashed whole, a piece at a time.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    marked = settled(fingerprints(own, name="fp", shingle=shingle))
    prints = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("many"))
    roots = connected_components(ball_links(prints.select("fp")), "a", "b").select(F.col("node").alias("fp"), "root")
    rooted = prints.join(roots, "fp", "left").select("fp", "first", "many", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    placed = settled(rooted.join(lowest, "root").select("fp", "component_id", "many"))
    return looked_up(marked, placed, "fp", "many").select("doc_id", "fp", "component_id")


def similar_links(docs: DataFrame, prints: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, root) of all sets of five-word shingles with a Jaccard of 0.8 or more, or joined by such sets.

    Fingerprints in one ball are candidates. As 0.8 is some ten bits, far out of any ball, the sets that share a
    shingle of their prefixes are candidates too, and those two share at 0.8 in any case. Candidates are
    verified on whole sets. First each set meets two hubs of each shingle, one of them the least edited, then eight
    others where that left several components, so that a large group joins up without its pairs; then what is outside
    a shingle's main component meets all sets that it can be linked with. ``prints`` is what ``shingles.marked``
    gives for ``docs``, written.
    """
    with scratch() as keep:
        met = keep(shingles.cells(prints))
        classes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.min("sim").alias("sim")))
        same = keep(classes.groupBy("sim").agg(F.min("fp").alias("rep")))
        inside = classes.join(same, "sim").where("fp <> rep").select(F.col("rep").alias("a"), F.col("fp").alias("b"))
        balls = ball_links(same.select(F.col("sim").alias("fp")))
        for side in ("a", "b"):
            balls = balls.join(same.select(F.col("sim").alias(side), F.col("rep").alias(f"r{side}")), side)
        balls = balls.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        known = None
        for turn in range(3):
            still = met.withColumn("root", F.col("fp")) if turn == 0 else keep(shingles.apart(met if turn == 1 else still, known))
            pairs = shingles.all_pairs(still) if turn == 2 else shingles.hub_pairs(still, range(2) if turn == 0 else range(2, 10))
            if turn == 0:
                pairs = pairs.unionByName(inside).unionByName(balls).distinct()
            pairs = keep(shingles.possible(keep(pairs), prints))
            if turn and pairs.isEmpty():
                continue
            named = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
            sets = keep(shingles.sets(docs, keep(classes.join(named, "fp").select("fp", "first")), doc_id, text))
            links = keep(shingles.verified(pairs, sets))  # else each task of the components holds a second worker
            if turn:
                links = links.unionByName(known.select(F.col("node").alias("a"), F.col("root").alias("b")))
            known = connected_components(links, "a", "b")
        return known


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each group, all its columns as they are.

    Texts whose five-word shingles have a Jaccard of 0.8 or more are near duplicates, and so are texts joined by
    such; null and empty texts are one group. The row with the smallest id stays, null last; of rows with that
    id the one with the smallest set fingerprint, and one of equal ones. An empty table gives no rows.

    What goes is joined by a broadcast if it is at most ``BROADCAST_ROWS`` keys and what stays has no repeated
    row: then no text is shuffled. Else one shuffle carries the texts, by fingerprint and id, so that a large
    group of copies is no hot key.
    """
    name, id_ = fresh(docs, "__fp"), fresh(docs, "__id")
    with scratch() as keep:
        prints = keep(shingles.marked(docs, doc_id, text))
        keys = prints.groupBy("fp", F.coalesce("doc_id", F.lit(LOWEST)).alias("id")).agg(F.count("*").alias("many"))
        roots = similar_links(docs, prints, doc_id, text).select(F.col("node").alias("fp"), "root")
        placed = keys.groupBy("fp").agg(F.min(F.struct((F.col("id") == LOWEST).alias("last"), "id")).alias("s")).join(roots, "fp", "left")
        least = placed.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min(F.struct("s.last", "s.id", "fp")).alias("s")).select("s.fp", "s.id", F.lit(True).alias("stays"))
        judged = settled(keys.join(least, ["fp", "id"], "left").select(F.col("fp").alias(name), F.col("id").alias(id_), "many", F.coalesce("stays", F.lit(False)).alias("stays")))
    rows = small_batches(docs).withColumn(name, _set_column()(F.col(text).cast("string"))).withColumn(id_, F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST)))
    going, again = judged.agg(F.count_if(~F.col("stays")), F.count_if(F.col("stays") & (F.col("many") > 1))).first()
    if going <= BROADCAST_ROWS and not again:
        return rows.join(F.broadcast(judged.where(~F.col("stays")).select(name, id_)), [name, id_], "left_anti").drop(name, id_)
    return rows.join(judged.where("stays").select(name, id_), [name, id_], "left_semi").dropDuplicates([name, id_]).drop(name, id_)


def _set_column():
    @F.pandas_udf("long")
    @lean
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([shingles.fingerprint(shingles.shingles(t)) for t in batch], dtype="int64")

    return of


def hexed(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
