"""Each stage of the pipeline on its own input, against plain versions."""

import hashlib
import re
from collections import Counter
from pathlib import Path

import duckdb
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillon.llm import common, components, mixing, simhash, toxicity
from tests.llm.test_shingles import plain_components

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted(((r["doc_id"], r["text"], r["source"]) for r in df.collect()), key=str)


def test_names_and_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mix", "tokens"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name


def test_the_filters_keep_clean_documents_and_drop_the_others(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    marks = {r["doc_id"]: r for r in labels.collect()}
    for name, label, bad, least in (("toxicity", "toxic", 1, 0.6), ("quality", "quality", 0, 0.95)):  # there are 33 toxic texts to learn from
        kept = {r["doc_id"] for r in STAGES[name](spark, docs, sf).select("doc_id").collect()}
        poor, fine = ([d for d, r in marks.items() if (r[label] == bad) == b] for b in (True, False))
        assert sum(d not in kept for d in poor) >= least * len(poor), name
        assert sum(d in kept for d in fine) >= 0.98 * len(fine), name


def test_the_first_stage_is_its_operator(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in STAGES["toxicity"](spark, docs, SF).collect()}
    assert kept == {r["doc_id"] for r in toxicity.report(docs, labels).where("not toxic").collect()}


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = rows_of(docs)
    expected = sorted(min(rows[i][0] for i in group) for group in plain_components(rows))
    assert sorted(r["doc_id"] for r in STAGES["near_duplicates"](spark, docs, SF).collect()) == expected


def test_the_mix_against_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    copies = {d: c for d, c in con.execute(f"SELECT doc_id, copies FROM ({mixing.oracle()})").fetchall() if c}
    assert Counter(r["doc_id"] for r in STAGES["mix"](spark, docs, SF).collect()) == copies


def test_tokens_against_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r["doc_id"]: r for r in STAGES["tokens"](spark, docs, SF).collect()}
    for doc, text, _ in rows_of(docs):
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert found[doc]["n_tokens"] == len(ids) and found[doc]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[doc]["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()


def test_clashing_columns_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("*", "1 AS toxicity", "2 AS quality", "3 AS __fp", "4 AS __row", "5 AS `a``b.c`")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF)
        assert docs.columns[-5:] == ["toxicity", "quality", "__fp", "__row", "a`b.c"]
    assert docs.selectExpr("min(toxicity)", "max(quality)", "min(__fp)", "max(__row)", "max(`a``b.c`)").first() == (1, 2, 3, 4, 5)


def test_awkward_rows_go_through_every_stage(spark, tmp_path):
    made = [(1, "one two three four five six", "en", "a", 9), (2, None, None, None, None), (None, "", "en", "a", 0), (None, None, None, "b", None), (1, "one two three four five six", "en", "a", 9), (5, "long " * 30_000, "en", "b", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows, labels in ((made, [(1, 1, 0), (5, None, 1), (None, 0, 1), (1, 1, 0)]), (made, []), ([], [])):
        folder = str(tmp_path / f"{len(rows)}-{len(labels)}")
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        found = corpus_pipeline.run(spark, folder)
        assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        assert (found.count() > 0) == bool(rows)


def test_run_is_its_stages(spark):
    found = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert 0 < found.count() and found.exceptAll(docs).count() == docs.exceptAll(found).count() == 0


def test_a_worker_gives_back_what_its_task_has_freed():
    def anonymous():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    pins = []  # what stays above the freed blocks keeps the C library from giving them back by itself

    def task(batches):
        blocks = [bytearray(1000) for _ in range(200_000)]
        pins.append(bytearray(1000))
        for batch in batches:
            yield batch + len(blocks)

    before = anonymous()
    assert list(common.lean(task)(iter([1, 2]))) == [200_001, 200_002]
    assert anonymous() - before < 60


def test_links_are_written_before_they_are_joined_up(spark, monkeypatch):
    """A task that verifies pairs and joins them up too would hold two workers."""
    plans = []

    def joined(links, a, b):
        plans.append(links._jdf.queryExecution().toString())
        return components.connected_components(links, a, b)

    monkeypatch.setattr(simhash, "connected_components", joined)
    STAGES["near_duplicates"](spark, spark.read.parquet(f"{SF}/documents.parquet"), SF).count()
    assert plans and not any("MapInArrow" in p for p in plans)
