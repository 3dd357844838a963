"""The queries of this folder, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillon.llm import bpe, chat, langid, lattice, licenses, mixing, quality, simhash, spotsigs, toxicity
from quillon.llm.common import table


def vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


Query = Callable[[SparkSession, str], DataFrame]


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; see ``spotsigs.neighbours``."""
    return spotsigs.neighbours(table(spark, sf_dir, "documents"))


def op2_e8_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``; see ``lattice.near_duplicates``."""
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` mixed; see ``mixing.mix``."""
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; see ``licenses.scan``."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; see ``langid.report``."""
    return langid.report(table(spark, sf_dir, "documents"))


def op6_chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``conversations`` and conversation -1, formatted and read back; see ``chat.format_turns`` and ``chat.digest``."""
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql(f"select -1L conv_id, id turn, if(id = 0, 'user', 'assistant') role, '{said}' text from range(2)")
    return chat.digest(chat.format_turns(chat.text_parts(turns.unionByName(more))))


def op7_bpe_speculative(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All of ``documents`` encoded and decoded; see ``bpe.encode`` and ``bpe.decode``."""
    return bpe.digest(table(spark, sf_dir, "documents"), path or vocabulary())


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; see ``toxicity.report``."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; see ``simhash.near_duplicates``."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexed("fp").alias("fingerprint"), "component_id")


def op10_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; see ``quality.report``."""
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``op1_spotsigs`` SQL can say: doc_id, n_chars, edited_sha256."""
    return op1_spotsigs(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``op4_license_index`` SQL can say: the words and the base phrases."""
    return op4_license_index(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def queries() -> dict[str, Query]:
    found = (
        op1_spotsigs, op2_e8_lattice, op3_systematic_mix, op4_license_index, op5_zstd_language,
        op6_chat_parts, op7_bpe_speculative, op8_toxicity_chain, op9_simhash_ball, op10_nbsvm_quality,
        edited_texts, license_places,
    )
    return {f.__name__: f for f in found}


def _chat_sql() -> str:
    """Turns and lengths straight from the table; the escaped length is the text's, one more for each backslash and each control string."""
    marked = lambda c: " + ".join([f"length({c}) + (length({c}) - length(replace({c}, chr(92), '')))", *[f"(length({c}) - length(replace({c}, '{m}', ''))) // {len(m)}" for m in chat.CONTROL]])
    said = "'</s>[INST] ok [/INST]'"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', {said}), (-1, 1, 'assistant', {said}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({len(chat.OPEN + chat.MIDDLE + chat.CLOSE)} + {marked('role')} + {marked('text')})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


_LATTICE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM low"""


_EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lead(coalesce(text, '')) OVER (ORDER BY doc_id) AS following, first(coalesce(text, '')) OVER (ORDER BY doc_id) AS head FROM documents),
e AS (SELECT doc_id, text, length(text) AS n, length(text) // 2 AS half, coalesce(following, head) AS other FROM d)
SELECT doc_id, n AS n_chars, sha256(substring(text, 1, n - half) || substring(other, 1, half)) AS edited_sha256 FROM e"""


def _places_sql() -> str:
    """Each phrase at each start of the list of words."""
    starts = ", ".join(
        f"list_filter(range(0, len(w)), lambda i: {' AND '.join(f'w[i + {k + 1}] = {chr(39)}{word}{chr(39)}' for k, word in enumerate(phrase.split()))}) AS s{n}"
        for n, (_, phrase) in enumerate(licenses.BASE)
    )
    count = len(licenses.BASE)
    every = " || ".join(f"s{n}" for n in range(count))
    labels = ", ".join(f"CASE WHEN len(s{n}) > 0 THEN '{label}' END" for n, (label, _) in enumerate(licenses.BASE))
    return f"""
WITH words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
found AS (SELECT doc_id, len(w) AS n_words, {starts} FROM words)
SELECT doc_id, n_words, len({every}) AS n_base, list_min({every}) AS first_word, list_max({every}) AS last_word,
       array_to_string(list_sort(list_filter([{labels}], lambda x: x IS NOT NULL)), ',') AS base_labels FROM found"""


def oracle_sql() -> dict[str, str]:
    """SQL for the small tables; all pairs of vectors are too many for it on large ones."""
    return {"op2_e8_lattice": _LATTICE_SQL, "op3_systematic_mix": mixing.oracle(), "op6_chat_parts": _chat_sql(), "edited_texts": _EDITED_SQL, "license_places": _places_sql()}
