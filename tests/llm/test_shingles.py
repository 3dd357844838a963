"""Near duplicates by shingles of five words against all pairs of texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import shingles, simhash
from quillon.llm.common import written

DOCS = "doc_id long, text string, lang string"


def plain_shingles(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows):
    """The sets of row numbers that are joined by a Jaccard of 0.8 or more, from all pairs."""
    sets, root = [plain_shingles(r[1]) for r in rows], list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, x in enumerate(sets):
        for j in range(i):
            if x == sets[j] or 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return list(groups.values())


def edited(rng, text, edits):
    words = text.split()
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def fixture():
    """Groups of edited copies on both sides of 0.8, a passage in half the texts, copies, short, empty and null texts."""
    rng, texts = random.Random(7), []
    line = " ".join(f"w{rng.randrange(50)}" for _ in range(60))
    for k in range(40):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 160))) + (" " + line if k % 2 else "")
        texts += [base, *(edited(rng, base, e) for e in rng.sample(range(0, 8), 3))]
    big = " ".join(f"v{rng.randrange(3000)}" for _ in range(200))
    texts += [edited(rng, big, 4) for _ in range(60)]
    texts += ["one two", "One  TWO", "one two three", "", None, " \n", "a b c d e f g h i"]
    rng.shuffle(texts)
    return [(i, t, "en") for i, t in enumerate(texts)]


def components(spark, rows):
    """The smallest row number of each row's component, by the operator."""
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    prints = written(shingles.marked(docs), "prints")
    roots = {r["node"]: r["root"] for r in simhash.similar_links(docs, prints).collect()}
    of = {r["doc_id"]: roots.get(r["fp"], r["fp"]) for r in prints.collect()}
    first = {}
    for i in sorted(of):
        first.setdefault(of[i], i)
    return {i: first[r] for i, r in of.items()}


def test_all_pairs_from_0_8_on_and_no_others(spark):
    rows = fixture()
    assert components(spark, rows) == {i: min(g) for g in plain_components(rows) for i in g}


def test_a_large_group_joins_up_without_its_pairs(spark, monkeypatch):
    """Each copy has a Jaccard of 0.8 to the text with no edits alone, so that hubs which are drawn don't join them."""
    rng, made = random.Random(3), []
    base = " ".join(f"w{i}" for i in range(150))
    rows = [(i, edited(rng, base, 3) if i != 70 else base, "en") for i in range(200)]
    monkeypatch.setattr(shingles, "ORDER_SHARE", 1)
    possible = shingles.possible
    monkeypatch.setattr(shingles, "possible", lambda pairs, prints: made.append(pairs.count()) or possible(pairs, prints))
    assert components(spark, rows) == {i: min(g) for g in plain_components(rows) for i in g}
    assert sum(made) < 10 * len(rows)


def test_a_group_that_is_joined_up_is_not_compared_with_itself(spark, monkeypatch):
    """Of 300 sets on a shingle all but three are in one component; no task may meet all pairs of the cell, whether or not it gives them."""
    seen, distinct = [], shingles._distinct
    monkeypatch.setattr(shingles, "_distinct", lambda met: seen.append(met.count()) or distinct(met))
    still = spark.createDataFrame([(g, i, 10, g, i if i < 3 else 99) for i in range(300) for g in (1, 2, 3)], "gram long, fp long, n long, at long, root long")
    found = {(r["a"], r["b"]) for r in shingles.all_pairs(still).collect()}
    assert found == {(a, b) for a in range(3) for b in range(a + 1, 300)} and sum(seen) <= 3 * 3 * 300


def test_the_bounds_lose_no_link_between_sets_of_different_size(spark):
    """Shingles that one set has in its prefix and the other behind it are no cell, and count all the same."""
    rng, sets = np.random.default_rng(11), []
    for k in range(300):  # a set, what is left of it without some, and with others put in
        whole = 1000 * k + rng.choice(1000, rng.integers(5, 120), replace=False)
        for less in rng.uniform(0, 0.2, 1 + k % 3):
            part = rng.permutation(whole)[int(less * len(whole)) :]
            sets.append(np.unique(np.concatenate([part, 1000 * k + rng.choice(1000, rng.integers(0, 1 + len(whole) // 12))])))
        sets.append(np.sort(whole))
    none = np.zeros(0, dtype=np.int64)
    prints = spark.createDataFrame([(i, len(s), shingles.prefix(s, none, none).tolist()) for i, s in enumerate(sets)], "fp long, n long, prefix array<long>")
    met = shingles.cells(prints).withColumn("root", F.col("fp"))
    found = {(r["a"], r["b"]) for r in shingles.all_pairs(met).collect()}
    alike = lambda x, y: 5 * len(x & y) >= 4 * len(x | y)
    plain = [set(s.tolist()) for s in sets]
    near = {(i, j) for i, x in enumerate(plain) for j in range(i + 1, min(i + 5, len(plain))) if alike(x, plain[j])}
    assert len(near) > 200 and near <= found


def test_the_order_of_shingles_changes_no_result(spark, monkeypatch):
    rows = fixture()
    monkeypatch.setattr(shingles, "ORDER_SHARE", 1)
    monkeypatch.setattr(shingles, "SEEN", 3)
    assert components(spark, rows) == {i: min(g) for g in plain_components(rows) for i in g}


def test_shuffles_in_place_of_broadcasts_change_no_result(spark, monkeypatch):
    rows = fixture()
    for module in (shingles, simhash):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 2)
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted(r["doc_id"] for r in simhash.one_of_each(docs).collect()) == sorted(min(g) for g in plain_components(rows))


def test_words_are_told_apart_and_pieces_change_nothing(monkeypatch):
    text = "Hello world  foo\tbar\n" + "z" * 50 + " hello WORLD q ab ba a b aa é É \x85x " * 3
    codes = shingles.word_codes(text)
    words = text.encode().lower().split()
    assert len(codes) == len(words) and len(set(codes.tolist())) == len(set(words))
    assert (codes[:, None] == codes[None]).tolist() == [[a == b for b in words] for a in words]
    whole = shingles.shingles(text)
    monkeypatch.setattr(shingles, "PIECE", 7)
    assert (shingles.word_codes(text) == codes).all() and (shingles.shingles(text) == whole).all()
    assert len(shingles.shingles("a b c d e f g")) == 3 and (shingles.shingles("a b c") != shingles.shingles("c b a")).all()


@pytest.mark.parametrize("text", [None, "", " \n", "one", "a b c d e f g " * 50])
def test_simhash_of_a_set(text):
    grams = shingles.shingles(text)
    ones = [sum(int(g) >> b & 1 for g in grams.byteswap().tolist()) for b in range(64)]
    assert simhash.shingles.simhash_of(grams) & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def test_the_stage_drops_edited_copies(spark):
    rows = fixture()
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(rows, DOCS), "")
    assert kept.columns == ["doc_id", "text", "lang"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(min(g) for g in plain_components(rows))


def test_no_rows_and_null_ids(spark):
    assert simhash.one_of_each(spark.createDataFrame([], DOCS)).count() == 0
    words = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(None, words, "en"), (None, words + " more", "en"), (None, "other", "en"), (5, words + " and", "en")], DOCS)
    assert sorted((r["doc_id"] or 0, r["text"][:5]) for r in simhash.one_of_each(docs).collect()) == [(0, "other"), (5, "w0 w1")]


def test_one_row_of_each_group_with_repeated_or_null_ids(spark):
    words = [" ".join(f"{p}{i}" for i in range(100)) for p in "abc"]
    repeated = [(1, words[0], "en"), (1, words[0] + " more", "en"), (1, words[0] + " more", "en"), (2, words[0] + " and", "en")]
    nulls = [(None, words[1], "en"), (None, words[1] + " more", "en"), (None, words[1] + " and", "en"), (None, words[2], "en")]
    kept = corpus_pipeline.one_of_each(spark, spark.createDataFrame(repeated + nulls, DOCS), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"][0]) for r in kept) == [(0, "b"), (0, "c"), (1, "a")]
