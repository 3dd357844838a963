"""Byte-level BPE by speculation: longest matches are proposed, adjacent pairs verified, failures merged exactly."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import fresh, lean, small_batches

# The pattern that splits text before merging, and the bytes that stand for themselves in token names.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

CACHED_WORDS, CACHED_PAIRS, CHUNK_CHARS = 200_000, 1_000_000, 1_000_000
SHORT, ROWS = 48, 500  # bytes of a word that is merged in a plain list; rows that are handed on at a time
HEAD = 4  # bytes by which it is known how long a token can be


def byte_names() -> dict[str, int]:
    """The character that names each byte: itself where printable, else the next one from 256 on."""
    rest = [b for b in range(256) if b not in set(PLAIN)]
    return {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """One vocabulary, read from the bytes of its JSON file. Caches are bounded and change no result."""

    def __init__(self, file: bytes, cached: int | None = None):
        self.cached = cached or CACHED_WORDS
        spec = json.loads(file)
        names = byte_names()
        model = spec["model"]
        self.ids = {bytes(names[c] for c in token): i for token, i in model["vocab"].items()}
        self.raw = {i: b for b, i in self.ids.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.reach: dict[bytes, int] = {}  # the longest token that starts with these bytes
        for token in self.ids:
            if len(token) >= HEAD:
                self.reach[token[:HEAD]] = max(len(token), self.reach.get(token[:HEAD], 0))
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        of = lambda name: self.ids[bytes(names[c] for c in name)]
        self.ranks = {(of(a), of(b)): rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [of(a + b) for a, b in pairs]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.raw |= {i: t.encode() for t, i in self.added.items()}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, bytes] = {}  # a word's ids, four bytes each
        self.older: dict[str, bytes] = {}
        self.known, self.fits = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
        self.sound: dict[int, bool] = {}
        self.merged_exactly = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest rank first, the leftmost among equals."""
        ids = list(map(self.single.__getitem__, word))
        if len(ids) > SHORT:
            return self._merge_long(ids)
        get, none = self.ranks.get, len(self.merged)
        ranks = list(map(get, zip(ids, ids[1:]), repeat(none)))
        while ranks:
            lowest = min(ranks)
            if lowest == none:
                break
            i = ranks.index(lowest)
            ids[i : i + 2] = [self.merged[lowest]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same for long words, by a heap over a linked list."""
        get, merged = self.ranks.get, self.merged
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(rank, i, *pair) for i, pair in enumerate(zip(ids, ids[1:])) if (rank := get(pair)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merged[rank], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (rank := get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (rank, left, ids[left], ids[right]))
        return [i for i in ids if i >= 0]

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match."""
        if (whole := self.ids.get(word)) is not None:
            return [whole]
        out, at, n = [], 0, len(word)
        ids, reach = self.ids.get, self.reach.get
        while at < n:
            end = at + reach(word[at : at + HEAD], HEAD - 1)
            if end > n:
                end = n
            while (token := ids(word[at:end])) is None:
                end -= 1
            out.append(token)
            at = end
        return out

    def is_sound(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token."""
        if (known := self.sound.get(token)) is None:
            known = self.sound[token] = self.merge(self.raw[token]) == [token]
        return known

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For adjacent tokens, whether merging their joined bytes gives just the two."""
        codes, back = np.unique(left << 32 | right, return_inverse=True)
        at = np.searchsorted(self.known, codes)
        new = codes[self.known[np.minimum(at, len(self.known) - 1)] != codes] if len(self.known) else codes
        if len(new):
            verdict = [self.merge(self.raw[a] + self.raw[b]) == [a, b] for a, b in zip((new >> 32).tolist(), (new & 0xFFFFFFFF).tolist(), strict=True)]
            if len(self.known) + len(new) > CACHED_PAIRS:
                keep = np.isin(self.known, codes)
                self.known, self.fits = self.known[keep], self.fits[keep]
            at = np.searchsorted(self.known, new)
            self.known, self.fits = np.insert(self.known, at, new), np.insert(self.fits, at, verdict)
        return self.fits[np.searchsorted(self.known, codes)][back]

    def learn(self, words: Iterable[str]) -> None:
        """Adds the encodings of distinct words to the cache.

        If every token is sound and every adjacent pair compatible, the proposal is what merging gives.
        """
        words = list(words)
        raw = [w.encode() for w in words]
        tokens = [self.propose(w) for w in raw]
        lengths = np.array([len(t) for t in tokens])
        flat = np.fromiter(chain.from_iterable(tokens), dtype=np.int64, count=int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = owner[1:] == owner[:-1]
        fails = np.zeros(len(words), dtype=bool)
        fails[owner[1:][inside][~self.compatible(flat[:-1][inside], flat[1:][inside])]] = True
        unsound = [t for t in np.unique(flat).tolist() if not self.is_sound(t)]
        if unsound:
            fails[owner[np.isin(flat, unsound)]] = True
        for i in np.flatnonzero(fails).tolist():
            tokens[i] = self.merge(raw[i])
        self.merged_exactly += int(fails.sum())
        packed = np.fromiter(chain.from_iterable(tokens), dtype=np.int32).tobytes()
        ends = np.cumsum([0, *map(len, tokens)]) * 4
        self.cache.update((w, packed[a:b]) for w, a, b in zip(words, ends[:-1].tolist(), ends[1:].tolist(), strict=True))

    def encode_batch(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text, as the vocabulary's own library gives them; null is empty."""
        for start, end in _chunks(texts):
            split = [self._split(t or "") for t in texts[start:end]]
            if len(self.cache) > self.cached:  # the words in use come back from the older half
                self.older, self.cache = self.cache, {}
            if missing := set().union(*(words for words, _ in split)).difference(self.cache):
                self.cache.update((w, self.older[w]) for w in missing if w in self.older)
                if missing := missing.difference(self.cache):
                    self.learn(missing)
            get = self.cache.__getitem__
            for words, added in split:
                pieces = list(map(get, words))
                for place, token in reversed(added):
                    pieces.insert(place, token.to_bytes(4, "little"))
                yield np.frombuffer(b"".join(pieces), dtype="<i4")

    def _split(self, text: str) -> tuple[list[str], list[tuple[int, int]]]:
        """The words of a text, and before which of them an added token stands."""
        if not self.split_added or not any(t in text for t in self.added):
            return self.words.findall(text), []
        words: list[str] = []
        added: list[tuple[int, int]] = []
        for part in self.split_added.split(text):
            if part in self.added:
                added.append((len(words), self.added[part]))
            else:
                words += self.words.findall(part)
        return words, added

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= CHUNK_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _shared(df: DataFrame, path: str):
    """The vocabulary file as a broadcast: its size is that of one vocabulary, whatever the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _made(file, cached: int | None = None) -> Bpe:
    """The vocabulary of a broadcast file, made once in each worker: tasks that follow find its caches filled."""
    if not hasattr(file, "made"):
        file.made = Bpe(file.value, cached)
    return file.made


def _lists(found: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int32), *found])))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), ROWS):
            yield batch.slice(at, ROWS)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", decoded: str | None = None, cached: int | None = None) -> DataFrame:
    """``df`` with its text column replaced by the array of token ids and, if ``decoded`` names it, their text again.

    Null and empty texts have no ids and decode to an empty text. Repeated rows stay; other columns pass
    through. A text is encoded whole; a batch is handed on 500 rows at a time. ``cached`` words are kept
    by each worker: fewer take less memory and more time, and change no result.
    """
    file, ids = _shared(df, path), fresh(df, ids)
    kept = [f for f in df.schema if f.name != text]
    more = [T.StructField(decoded, T.StringType())] if decoded else []

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _made(file, cached)
        for batch in _slices(batches):
            found, texts = [], []
            for tokens in bpe.encode_batch(batch.column(text).to_pylist()):
                found.append(tokens)
                if decoded:
                    texts.append(bpe.decode(tokens.tolist()))
            columns = [*[batch.column(f.name) for f in kept], _lists(found), *([pa.array(texts, pa.string())] if decoded else [])]
            yield pa.RecordBatch.from_arrays(columns, names=[*[f.name for f in kept], ids, *([decoded] if decoded else [])])

    return small_batches(df).mapInArrow(run, T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), *more]))


def decode(df: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with the text of its token ids; a null array gives null."""
    file, text = _shared(df, path), fresh(df, text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _made(file)
        for batch in _slices(batches):
            values = [bpe.decode(x.values.to_pylist()) if x.is_valid else None for x in batch.column(ids)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, type=pa.string())], names=[*batch.schema.names, text])

    return small_batches(df).mapInArrow(run, T.StructType([*df.schema, T.StructField(text, T.StringType())]))


def digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", cached: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), from the ids and from the text decoded again."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    coded = encode(own, path, decoded="decoded", cached=cached)
    joined = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
