"""Mixing, tokens, chat, licences, languages and classifiers against plain versions, with the awkward rows."""

import hashlib
import math
import os
import pickle
import random
import re
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import bpe, chat, langid, licenses, mixing, quality, registry, toxicity
from quillon.llm.grams import Grams, Stems

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
DOCS = "doc_id long, text string, lang string, source string, mix_copies string, token_ids string, quality string"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Bpe(open(PATH, "rb").read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def awkward(spark):
    rows = [(1, "one two three", "en", "a", "x", None, "q"), (2, None, None, None, None, None, None), (3, "", "en", "a", None, None, None), (None, "the idiot", "de", "b", None, None, None), (1, "one two three", "en", "a", "x", None, "q"), (5, "long " * 30_000, "en", "b", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_mix_stays_near_targets_and_caps(spark):
    draw = random.Random(1)
    rows = [(i, " ".join(["w"] * draw.randint(0, 300)), None, draw.choice(["a", "b", "c", "d", None]), None, None, None) for i in range(4000)]
    found = mixing.mix_report(spark.createDataFrame(rows, DOCS)).collect()
    assert len(found) == 4000 and all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    total = sum(r["size"] for r in found)
    by = {}
    for r in found:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (size, target), taken in by.items():
        assert target <= 2 * size and abs(sum(taken) - target) < 0.02 * target


def test_mix_depends_on_the_rows_alone(spark):
    rows = [(i % 3 if i % 5 else None, " ".join(["w"] * (60 + i % 9)) + f" {i}", None, "a", None, None, None) for i in range(400)]
    draw, seen = random.Random(5), set()
    for parts in (1, 3, 7):
        draw.shuffle(rows)
        report = mixing.mix_report(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()
        taken = tuple(sorted((r["doc_id"] or -1, r["size"], r["taken"]) for r in report))
        mixed = tuple(sorted(Counter(r["text"] for r in mixing.mix(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()).items()))
        seen.add((taken, mixed))
    assert len(seen) == 1


def test_mix_rows(spark):
    docs = awkward(spark)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    report = mixing.mix_report(docs)
    assert report.count() == 6 and {r["size"] for r in report.collect()} == {0, 2, 3, 30_000}
    assert sum(r["copies"] for r in report.collect()) == out.count()
    assert mixing.mix(docs.where("doc_id > 9")).count() == 0 and mixing.mix_report(docs.where("doc_id > 9")).count() == 0


def test_bpe_against_the_library(vocabulary, library):
    draw = random.Random(2)
    texts = ["", "a<|endoftext|>b<|endoftext|>", "x" * 5000, "ab" * 3000, " " * 999, "it's  the\n\n  end\t"]
    alphabet = "abc ABC  \n\t\x85\xa0　\x1c'tsredvml09²½é漢字😀​́_-!?|<>\x00"
    texts += ["".join(draw.choice(alphabet) for _ in range(draw.randrange(60))) for _ in range(1500)]
    for text, ids in zip(texts, vocabulary.encode_batch(texts), strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert vocabulary.decode(ids.tolist()) == text


@settings(max_examples=200, deadline=None)
@given(text=st.text())
def test_bpe_round_trip(vocabulary, library, text):
    ids = next(vocabulary.encode_batch([text])).tolist() if text else []
    assert ids == library.encode(text, add_special_tokens=False).ids and vocabulary.decode(ids) == text


def test_bpe_speculation_is_verified(vocabulary):
    word = b" supercalifragilistic"
    assert vocabulary.merge(word) == vocabulary._merge_long([vocabulary.single[b] for b in word])
    before = vocabulary.merged_exactly
    vocabulary.learn({" anean", " thndre", " reoner", " qzxv", " unhappiest", " misthrown"})
    assert vocabulary.merged_exactly >= before


def test_bpe_cache_bound_changes_nothing(vocabulary, monkeypatch):
    texts = [f"word{i} another{i} thing" for i in range(300)]
    whole = [x.tolist() for x in vocabulary.encode_batch(texts)]
    monkeypatch.setattr(bpe, "CACHED_WORDS", 10)
    monkeypatch.setattr(bpe, "CACHED_PAIRS", 20)
    monkeypatch.setattr(bpe, "CHUNK_CHARS", 50)
    assert [x.tolist() for x in bpe.Bpe(open(PATH, "rb").read()).encode_batch(texts)] == whole


def test_bpe_query_against_the_library(spark, library):
    found = {r["doc_id"]: r for r in registry.op7_bpe_speculative(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (found[r["doc_id"]]["n_tokens"], found[r["doc_id"]]["ids_sha256"], found[r["doc_id"]]["decoded_sha256"]) == expected


def test_bpe_rows(spark):
    found = {(r["doc_id"], r["n_tokens"]): r for r in bpe.digest(awkward(spark), PATH).collect()}
    assert found[(2, 0)]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert {r["decoded_sha256"] for r in found.values()} == {hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in awkward(spark).collect()}
    coded = bpe.encode(awkward(spark), PATH)
    assert coded.columns[-1] == "token_ids_" and coded.count() == 6
    back = bpe.decode(coded, PATH, ids="token_ids_").collect()
    assert sorted(r["decoded"] for r in back) == sorted(r["text"] or "" for r in awkward(spark).collect())
    assert bpe.digest(awkward(spark).where("doc_id > 9"), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="<>|/[]INST\\sSY:end turn", max_size=40) | st.text(), role=st.text(max_size=8))
def test_chat_round_trip(text, role):
    part = {"kind": "text", "text": text}
    string, start, end, _ = chat.segment(role, [part])
    assert chat.read_back(string) == (role, text) and chat.unescape(string[start:end]) == text
    assert not any(mark in string[start:end] for mark in chat.CONTROL)


def test_chat_parts():
    blank = dict.fromkeys(("text", "ref", "width", "height", "seconds", "pages"))
    parts = [blank | {"kind": "text", "text": "see "}, blank | {"kind": "image", "ref": "i.png", "width": 28, "height": 15}, blank | {"kind": "audio", "ref": "a.wav", "seconds": 1.5}, blank | {"kind": "document", "ref": "d.pdf", "pages": 2}, blank | {"kind": "video", "ref": "v"}, None]
    string, _, _, flat = chat.segment("user", parts)
    assert "see <|image:0|><|audio:1|><|document:2|><|unknown:3|><|unknown:4|>" in string
    assert flat.attachments[:4] == [(0, "image", "i.png", 4), (1, "audio", "a.wav", 38), (2, "document", "d.pdf", 512), (3, "unknown", "v", 0)] and flat.tokens == 554


def test_chat_placeholders_are_told_from_texts():
    blank = dict.fromkeys(("text", "ref", "width", "height", "seconds", "pages"))
    parts = [blank | {"kind": "text", "text": "<|image:0|> \\ <"}, blank | {"kind": "image", "ref": "i"}, blank | {"kind": "text", "text": "|>"}, blank | {"kind": "audio", "ref": "a"}]
    string, *_ = chat.segment("user", parts)
    assert chat.read_parts(string) == ("user", [("text", "<|image:0|> \\ <"), ("image", 0), ("text", "|>"), ("audio", 1)])
    assert chat.read_back(string) == ("user", "<|image:0|> \\ <|>")
    long = "[INST]<|x|>\\ é" * 100_000
    assert chat.read_back(chat.segment("assistant", [blank | {"kind": "text", "text": long}])[0]) == ("assistant", long)


def test_chat_query_against_a_loop(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    found = {r["conv_id"]: r for r in registry.op6_chat_parts(spark, SF).collect()}
    assert set(found) == set(turns)
    for conv, said in turns.items():
        learnt = "".join(t for role, t in said if role == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(said), len(learnt))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learnt.encode()).hexdigest()


def test_chat_rows(spark):
    rows = [(1, 2, "assistant", None, 1), (1, 1, None, "", 2), (None, 1, "user", "x", 3), (1, 1, None, "", 4)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    found = {r["conv_id"]: r for r in chat.digest(chat.format_turns(chat.text_parts(turns))).collect()}
    assert found[1]["n_turns"] == 3 and found[1]["loss_chars"] == 0 and found[None]["n_turns"] == 1
    assert chat.digest(chat.format_turns(chat.text_parts(turns.where("conv_id > 5")))).count() == 0


def plain_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    starts, labels = [], set()
    for label, phrase in licenses.BASE:
        wanted = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(wanted)] == wanted]
        starts += hits
        labels |= {label} if hits else set()
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def test_license_places(spark):
    texts = [None, "", "CC BY; cc by cc", "ÀLL rights reserved. All  Rights\nReserved!", "general public general public license", "Licensed under CC BY-NC 4.0.", "Released under the MIT License.", "the mit, license of apache", "Licensed under the Apache License, Version 2.0.", "all rights reserved " * 20_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "x")], "doc_id long, text string, labels string")
    rows = licenses.scan(docs).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(texts) + 1
    for i, text in enumerate(texts):
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_places(text)
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""} and 0 <= r["score"] <= 1
    assert [found[i]["labels"] for i in (5, 6, 7, 8)] == ["cc-by,cc-by-nc-4.0", "mit", "", "apache-2.0"]
    assert licenses.scan(docs.where("doc_id > 99")).count() == 0


def test_license_labels_against_plain_weights(spark):
    """Every template at every start of every text, with weights counted by hand."""
    texts = [" ".join(w.upper() if i % 2 else w for i, w in enumerate(words.split())) + "." for _, words, _ in licenses.TEMPLATES]
    draw = random.Random(3)
    for words in list(texts):  # and with some words changed, so that some miss the least share
        parts = words.split()
        for at in draw.sample(range(len(parts)), len(parts) // 4):
            parts[at] = "zz"
        texts.append("intro text " + " ".join(parts) + " of the license")
    texts += ["plain text", "", None, "mit license mit license released under the mit license"]
    found = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    split = [[w.decode() for w in licenses.words_of(t)] for t in texts]
    idf = {w: math.log((len(texts) + 1) / (sum(w in s for s in split) + 1)) + 1 for w in licenses.VOCABULARY}
    some = 0
    for i, words in enumerate(split):
        labels = {x for x in plain_places(texts[i])[4].split(",") if x}
        score = 1.0 if labels else 0.0
        for label, template, key in licenses.TEMPLATES:
            parts, wanted = template.split(), key.split()
            at = next(k for k in range(len(parts)) if parts[k : k + len(wanted)] == wanted)
            for start in range(-at, len(words)):
                if words[start + at : start + at + len(wanted)] != wanted:
                    continue
                hit = sum(idf[w] for k, w in enumerate(parts) if 0 <= start + k < len(words) and words[start + k] == w)
                if (share := hit / sum(idf[w] for w in parts)) >= licenses.LEAST:
                    labels.add(label)
                    score = max(score, min(1.0, share))
        assert found[i]["labels"] == ",".join(sorted(labels)) and abs(found[i]["score"] - score) < 1e-9
        some += bool(labels)
    assert len(licenses.TEMPLATES) <= some < len(texts)


def test_languages_on_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_languages_against_plain_compression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dictionaries = langid.trained(docs.select("doc_id", "text", "lang"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    labelled = {}
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None and r["text"]:
            labelled.setdefault(r["lang"], set()).update(re.sub(r"[\W\d_]+", " ", r["text"].lower()).split())
    assert set(dictionaries) == set(labelled) and all(set(d.decode(errors="ignore").split()[:-1]) <= labelled[lang] for lang, d in dictionaries.items())
    for r in langid.report(docs).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        words = re.sub(r"[\W\d_]+", " ", texts[r["doc_id"]].lower()).strip()
        if not words:
            assert r["lang_pred"] == "und"
            continue
        sizes = {}
        for lang, content in dictionaries.items():
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            shared.precompute_compress(level=6)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(level=6, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress(words[i : i + 4000].encode())) for i in range(0, len(words), 4000))
        assert r["lang_pred"] == min(sizes, key=lambda lang: (sizes[lang], lang)) and 0 <= r["score"] <= 1


def test_texts_without_a_letter_are_unknown(spark):
    rows = [(1, "der hund und die katze gehen in den garten", "de", "a", None, None, None), (2, "the dog and the cat go to the garden", "en", "a", None, None, None)] * 2
    rows = [(i * 3, *r[1:]) for i, r in enumerate(rows)] + [(100, "\u2460\u2461\u2462", None, "a", None, None, None), (101, "\u2167 \u00bd 12 _ !", None, None, None, None, None), (102, "\u2460 \u4e00", None, None, None, None, None)]
    found = {r["doc_id"]: r["lang_pred"] for r in langid.report(spark.createDataFrame(rows, DOCS)).collect()}
    assert found[100] == found[101] == "und" and found[102] != "und"


def test_a_rare_language_takes_nothing_from_the_others(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    before = langid.trained(docs)
    rare = next(i for i in range(10**6, 10**6 + 50) if zlib.crc32(str(i).encode()) % 3 != 1)
    after = langid.trained(docs.unionByName(spark.createDataFrame([(rare, "ab", "xx")] * 3, "doc_id long, text string, lang string")))
    assert {k: v for k, v in after.items() if k != "xx"} == before and len(after["xx"]) >= 8


def test_language_rows(spark):
    docs = awkward(spark)
    found = {(r["doc_id"], r["lang_pred"]) for r in langid.report(docs).collect()}
    assert (2, "und") in found and (3, "und") in found
    assert {r["lang_pred"] for r in langid.report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.report(docs.where("doc_id > 9")).count() == 0


def test_classifiers_on_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.report(docs, labels).join(labels.withColumnRenamed("quality", "is"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["is"] for r in rows) >= 0.97 * len(rows)
    rows = toxicity.report(docs, labels).withColumnRenamed("toxic", "said").join(labels, "doc_id").where("held_out").collect()
    assert sum(r["said"] == (r["toxic"] == 1) for r in rows) >= 0.93 * len(rows)


def sample(rows=120, seed=2):
    """Sets of numbers under 64 whose first eight depend on the class."""
    draw = random.Random(seed)
    y = np.array([float(i % 3 == 0) for i in range(rows)])
    return [np.array(sorted({draw.randrange(8) if c else draw.randrange(8, 16) for _ in range(3)} | {draw.randrange(16, 64) for _ in range(6)})) for c in y], y


def test_ratios_and_the_dual_against_plain_versions():
    rows, y = sample()
    ratio = quality.log_count_ratios(rows, y, 64)
    count = lambda k, f: sum(f in r.tolist() for r, c in zip(rows, y, strict=True) if c == k)
    total = [sum(len(r) for r, c in zip(rows, y, strict=True) if c == k) for k in (0, 1)]
    for f in range(64):
        expected = math.log((count(1, f) + 1) / (total[1] + 64) * (total[0] + 64) / (count(0, f) + 1)) if count(0, f) + count(1, f) else 0.0
        assert abs(ratio[f] - expected) < 1e-9
    w, bias = quality.hinge_fit(rows, y, ratio, epochs=300)
    x = np.zeros((len(rows), 65))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
        x[i, 64] = 1
    sign, cost = np.where(y > 0, 1, -1), np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    loss = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - sign * (x @ v))).sum()
    best, v = math.inf, np.zeros(65)
    for k in range(1, 4001):  # plain subgradient steps on the primal
        v = v - (v - x.T @ (cost * sign * (sign * (x @ v) < 1))) / (k + 20)
        best = min(best, loss(v))
    assert loss(np.append(w, bias)) <= best * 1.01


def test_a_link_against_plain_gradient_steps():
    rows, y = sample()
    before = np.array([[0.9 if c else 0.2] for c in y])
    link = toxicity.fit_link(rows, before, y, 64, steps=3000)
    x = np.column_stack([[[float(c in r) for c in link.columns] for r in rows], before, np.ones(len(y))]) if len(link.columns) else np.column_stack([before, np.ones(len(y))])
    ridge = np.full(x.shape[1], 0.005 / np.sqrt(len(y)))
    ridge[-1] = 0
    w = np.zeros(x.shape[1])
    for _ in range(60_000):
        w -= 0.3 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y) + ridge * w)
    plain, own = 1 / (1 + np.exp(-x @ w)), np.array([link.probability(r, list(b)) for r, b in zip(rows, before, strict=True)])
    assert np.abs(plain - own).max() < 0.02


def test_the_chain_feeds_earlier_probabilities(spark):
    rows, y = sample(300)
    chain = toxicity.fit(rows, np.column_stack([toxicity.kinds(rows, y, 1 << 20), y]), toxicity.CHAIN, Stems())
    again = toxicity.Chain.of_plain(pickle.loads(pickle.dumps(chain.plain())))
    assert [len(x.earlier) for x in again.links] == [0, 1, 2]
    for r in rows[:20]:
        plain, found = [], []
        for link in chain.links:
            z = link.bias + sum(w for c, w in zip(link.columns, link.weights, strict=True) if c in r) + sum(a * b for a, b in zip(link.earlier, plain, strict=True))
            plain.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        for link in again.links:
            found.append(link.probability(r, found))
        assert np.allclose(plain, found)


def test_kinds_come_from_the_labels():
    draw, rows = random.Random(1), []
    for i in range(300):  # two vocabularies of toxic texts, and clean ones
        own = {draw.randrange(0, 4)} if i % 3 == 0 else {draw.randrange(10, 14)} if i % 3 == 1 and i % 2 else set()
        rows.append(np.array(sorted(own | {draw.randrange(20, 60) for _ in range(4)})))
    toxic = np.array([float((r < 20).any()) for r in rows])
    found = toxicity.kinds(rows, toxic, 64)
    assert found.sum() > 0 and (found.sum(axis=1) <= toxic).all() and found[:, 0].sum() >= found[:, 1].sum()
    assert not toxicity.kinds(rows, np.zeros(300), 64).any() and toxicity.kinds([], np.zeros(0), 64).shape == (0, 2)


def test_models_work_where_the_package_is_not(tmp_path):
    """What executors get is loaded by a Python that can't import this package."""
    rows, y = sample()
    model = quality.fit([r for r in rows], y.astype(int), Grams(bits=6)).plain()
    chain = toxicity.fit(rows, np.column_stack([toxicity.kinds(rows, y, 1 << 20), y]), toxicity.CHAIN, Stems()).plain()

    def score(model, chain):
        return quality.QualityModel.of_plain(model).score("a b c"), toxicity.Chain.of_plain(chain).probabilities("a b c")

    path = tmp_path / "sent"
    path.write_bytes(pickle.dumps((cloudpickle.dumps(score), pickle.dumps((model, chain)))))
    code = f"import pickle; f, m = pickle.load(open({str(path)!r}, 'rb')); print(pickle.loads(f)(*pickle.loads(m)))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert found.stdout.strip() == str(score(model, chain)), found.stderr


def test_classifier_rows(spark):
    docs = awkward(spark)
    for labels in ([], [(1, 1, 0)], [(1, 1, 0), (5, None, 1), (None, 0, 1), (1, 1, 0)]):
        table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        rows = quality.report(docs, table).collect()
        assert len(rows) == 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
        rows = toxicity.report(docs, table).collect()
        assert len(rows) == 6 and all(r["toxic"] == (r["p_toxic"] >= 0.5) for r in rows) and (labels or not any(r["toxic"] for r in rows))
    assert quality.report(docs.where("doc_id > 9"), table).count() == 0


def test_grams_ignore_null_and_repeat():
    for made in (Grams(shapes=True), Stems()):
        assert len(made.of(None)) == len(made.of("")) == 0
        assert (made.of("a b a b") == made.of("a b a b")).all() and len(made.of("word " * 5000)) < 20
