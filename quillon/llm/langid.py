"""Language identification by compression against one raw-content dictionary for each language."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import fresh, held_out, listed, small_batches

SAMPLE_TEXTS, DICTIONARY = 60, 100_000  # the bound of the labelled sample: texts of a language; and bytes of its dictionary
PIECE = 4000  # characters compressed at a time; all pieces of a text count
NARROW = 0.01  # a lead under this share of the size is no decision

UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")
_NUMERALS = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isnumeric() and not c.isalpha()]  # as \u2460, which \w takes for letters
SUSPECT = re.compile(f"[{re.escape(''.join(c for c in _NUMERALS if c <= '\uffff'))}\U00010000-\U0010ffff]")  # few ranges, so that a search is quick
NUMERALS = re.compile(f"[{re.escape(''.join(_NUMERALS))}]")


def letters(text: str | None) -> str:
    """The lower-case words of a whole text, without numbers and marks, one space between them."""
    words = NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not words.isascii() and SUSPECT.search(words):
        words = " ".join(NUMERALS.sub(" ", words).split())
    return words


def compressors(dictionaries: dict[str, bytes], level: int = 6) -> list[tuple[str, zstandard.ZstdCompressor]]:
    """One compressor for each language, by name; made where they are used."""
    made = []
    for lang, content in sorted(dictionaries.items()):
        shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shared.precompute_compress(level=level)
        made.append((lang, zstandard.ZstdCompressor(level=level, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False)))
    return made


def predict(text: str | None, compressors: list[tuple[str, zstandard.ZstdCompressor]]) -> tuple[str, float, bool]:
    """(language, score, rejected). The smallest total size wins, the first name among equals.

    The score is 1 - 2 ** -(lead in hundredths of the size): 0 for no lead. A lead under ``NARROW`` is
    rejected, but still names the smallest. Without a letter (null, empty) the answer is ``und``, rejected.
    """
    words = letters(text)
    if not words or not compressors:
        return UNKNOWN, 0.0, True
    pieces = [words[i : i + PIECE].encode("utf-8", "surrogatepass") for i in range(0, len(words), PIECE)]
    sizes = sorted((sum(len(c.compress(p)) for p in pieces), lang) for lang, c in compressors)
    if len(sizes) == 1:
        return sizes[0][1], 1.0, False
    lead = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
    return sizes[0][1], 1.0 - 2.0 ** (-100 * lead), lead < NARROW


def trained(docs: DataFrame, texts: int = SAMPLE_TEXTS, dictionary: int = DICTIONARY) -> dict[str, bytes]:
    """The dictionary of each non-null language of ``docs``, from the whole of ``texts`` texts with a letter at most.

    Which texts depends on a hash of the id; none of the held-out fold. Only ids are ranked, cut down
    before any shuffle. Of a repeated id one text counts. A language's words are joined in that order until its
    dictionary has ``dictionary`` bytes, so that of two languages with enough text none wins by its size; a
    language with less keeps what it has, and takes nothing from the others. The driver gets the dictionaries
    alone: they grow with the number of languages, not with the documents.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "doc_id", "text")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = usable.select("lang", "doc_id").withColumn("rank", rank).where(F.col("rank") <= texts).select("lang", "doc_id").distinct()
    rows = usable.join(listed(chosen), ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        joined = "\n".join(map(letters, own.sort_values("doc_id")["text"])).encode("utf-8", "surrogatepass")
        while 0 < len(joined) < 8:  # the least that a dictionary may have
            joined += b"\n" + joined
        return pd.DataFrame({"lang": [key[0]], "content": [joined[:dictionary]]})

    found = rows.groupBy("lang").applyInPandas(run, "lang string, content binary").collect()
    return {r["lang"]: bytes(r["content"]) for r in found if r["content"]}


def identified(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", name: str = "language") -> DataFrame:
    """``docs`` with a struct (lang_pred, score, rejected) of each whole text. No shuffle.

    A column that is called like the struct already stays as it is; the new one gets underscores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)  # bounded by the sample

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        made = compressors(shared.value)
        for batch in batches:
            yield pd.DataFrame([predict(t, made) for t in batch], columns=["lang_pred", "score", "rejected"])

    return small_batches(docs).withColumn(fresh(docs, name), of(F.col(text)))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs``.

    Null, empty and letterless texts are ``und``; so is all where nothing is labelled. A null id is in no fold
    and no sample. Repeated rows stay rows; an empty table gives no rows. Other columns are ignored, whatever
    their names. Texts of any length are read whole, a piece at a time.
    """
    own = docs.select("doc_id", "text")
    found = identified(own, trained(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.*")
