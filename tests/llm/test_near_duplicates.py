"""SimHash, lattice and SpotSigs against plain versions, with the awkward rows."""

import hashlib
import os

import numpy as np
import xxhash

from quillon.llm import common, lattice, registry, shingles, simhash, spotsigs
from quillon.llm.components import connected_components, forest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, fp long"


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_components_of_a_chain_a_star_and_a_cycle(spark):
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 201), (201, 202), (202, 200), (5, 5), (None, 7)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    expected = plain_components({x for l in links for x in l if x is not None}, [l for l in links if None not in l])
    assert found == {n: r for n, r in expected.items()}


def test_no_links_no_components(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def plain_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \n", "one", "Two Words", "É x y z É x y", "a b c d " * 500):
        assert simhash.simhash(text) & (1 << 64) - 1 == plain_simhash(text)


def test_balls_find_all_links_up_to_three_bits(spark):
    rng = np.random.default_rng(3)
    prints = {0, -1, 1, (1 << 63) - 1}
    for base in rng.integers(-(1 << 62), 1 << 62, 12).tolist():
        for flips in (1, 2, 3, 3, 4, 5):
            value = base
            for bit in rng.choice(64, flips, replace=False).tolist():
                value ^= simhash._signed(1 << bit)
            prints |= {base, value}
    for start in range(4):  # a chain of steps of three bits
        prints |= {sum(7 << 3 * i for i in range(k)) << start for k in range(6)}
    prints = sorted(prints)
    links = simhash.ball_links(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()
    near = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3
    assert all(near(r["a"], r["b"]) for r in links)
    expected = plain_components(prints, [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if near(a, b)])
    assert plain_components(prints, [(r["a"], r["b"]) for r in links]) == expected


def test_simhash_rows(spark):
    rows = [(4, "a b c d", None, 1), (2, "A B  C\nD", "x", 2), (9, None, None, None), (7, "", "y", 0), (None, "q r s", None, 0), (2, "a b c d", None, 3)]
    found = sorted((r["doc_id"] or -1, r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect())
    assert found == [(-1, None), (2, 2), (2, 2), (4, 2), (7, 7), (9, 7)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_simhash_of_a_long_text_by_pieces(monkeypatch):
    text = " ".join(f"word{i % 97} x\ty" for i in range(4000)) + " " + "z" * 3000
    whole = simhash.simhash(text)
    monkeypatch.setattr(shingles, "PIECE", 64)
    assert simhash.simhash(text) == whole and whole & (1 << 64) - 1 == plain_simhash(text)
    assert [simhash.simhash(t) & (1 << 64) - 1 for t in ("one", " two words")] == [plain_simhash(t) for t in ("one", " two words")]


def test_hubs_and_hot_fingerprints_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT", 2)
    links = [(i, i + 1) for i in range(1, 30)] + [(100, 100 + i) for i in range(1, 20)] + [(200, 201), (201, 202), (202, 200)]
    frame = spark.createDataFrame(links, "a long, b long").repartition(4)
    expected = plain_components({x for l in links for x in l}, links)
    for one_task in (0, 1000):
        found = connected_components(frame, "a", "b", one_task=one_task).collect()
        assert len(found) == len(expected) and {r["node"]: r["root"] for r in found} == expected
    docs = spark.createDataFrame([(i, "a b c d" if i % 2 else f"text {i} of its own", None, 1) for i in range(20)], DOCS)
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == 20 and {r["component_id"] for r in rows if r["doc_id"] % 2} == {1}


def test_long_forests():
    order = np.random.default_rng(0).permutation(5000)
    node, root = forest(order[:-1], order[1:])
    assert (root == 0).all() and sorted(node.tolist()) == list(range(1, 5000))


def test_scratch_leaves_no_file(spark):
    with common.scratch() as keep:
        made = keep(spark.range(10))
        folder = made.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
        assert made.count() == 10 and os.path.isdir(folder)
    assert not os.path.exists(folder)


def test_nearest_points_are_lattice_points_and_nearest():
    x = np.random.default_rng(1).normal(size=(300, 8)) * 2
    point = lattice.nearest_point(x)
    assert (np.rint(2 * point) == 2 * point).all()
    assert ((point.sum(axis=1) % 2) == 0).all() and (np.ptp(np.abs(point - np.rint(point)), axis=1) == 0).all()
    around = point[:, None] + lattice.roots()[None]
    assert (((x - point) ** 2).sum(axis=1) <= ((x[:, None] - around) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()
    assert len(lattice.roots()) == 240 and np.allclose((lattice.roots() ** 2).sum(axis=1), 2)


def clustered(n_groups, size, noise, dim=64, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n_groups):
        base = rng.normal(size=dim)
        rows += [base + noise * rng.normal(size=dim) for _ in range(size)]
    return [r.astype(np.float32).tolist() for r in rows]


def test_lattice_links_against_all_pairs(spark):
    vectors = clustered(40, 8, 0.3) + clustered(1, 60, 0.05, seed=5)  # cosines on both sides of 0.9
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[9]]]
    found = {r["vec_id"]: r for r in lattice.near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")).collect()}
    a = np.array(vectors, dtype=float)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    near = a @ a.T >= 0.9
    np.fill_diagonal(near, False)
    links = np.array([found[i]["n_links"] for i in range(len(vectors))])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.95 * near.sum()
    assert found[len(vectors) - 3]["component_id"] == 0 and found[len(vectors) - 1]["n_links"] > 0
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found.values())


def test_tables_follow_the_number_of_vectors_and_keep_the_recall():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(1500, 64)), rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(1 - 0.81) * y / np.linalg.norm(y, axis=1, keepdims=True)
    before = (0, 0.0)
    for vectors in (100, 50_000, 1_000_000):
        tables, scale = lattice.shape(64, vectors, 0.9)
        (hx, ax), (hy, ay) = (lattice.Tables(64, tables, scale).cells(v) for v in (x, y))
        met = ((hx == hy) | (ax == hy[:, :, None]).any(axis=2) | (ay == hx[:, :, None]).any(axis=2)).any(axis=1)
        assert met.mean() >= 0.95 and (tables, scale) > before
        before = (tables, scale)
    assert lattice.shape(1, 10, 1.0)[0] >= 4


def test_lattice_chunks_lose_nothing(spark, monkeypatch):
    vectors = clustered(1, 90, 0.02, dim=16)
    monkeypatch.setattr(lattice, "CHUNK", 7)
    found = lattice.near_duplicates(spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<float>")).collect()
    assert {r["n_links"] for r in found} == {89} and {r["component_id"] for r in found} == {0}


def test_lattice_rows_that_cannot_be_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.0])]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert found == {1: (1, 1), 9: (1, 1), None: (0, None), **{i: (0, i) for i in range(2, 9)}}
    assert lattice.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_lattice_takes_vectors_of_any_size_and_other_columns(spark):
    rows = [(1, [1e200, 1e200], 1, "x"), (2, [1e200, 1.0001e200], 2, "y"), (3, [1e-320, 0.0], 3, "z"), (4, [5.0, 0.0], 4, "z")]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, cell int, v string")).collect()}
    assert found == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3)}


def plain_signatures(text):
    """The words' chains themselves."""
    words = spotsigs.WORD.findall((text or "").lower())
    found = set()
    for i, word in enumerate(words):
        after = [w for w in words[i + 1 :] if w not in spotsigs.ANCHORS][: spotsigs.CHAIN]
        if word in spotsigs.ANCHORS and len(after) == spotsigs.CHAIN:
            found.add((word, *after))
    return found or ({tuple(words)} if words else set())


def test_spotsigs_query_against_plain_chains(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    found = {r["doc_id"]: r for r in registry.op1_spotsigs(spark, SF).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for (doc, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, r = plain_signatures(text), found[doc]
        assert len(r["fingerprint"]) == 8 * len(own)
        assert abs(r["near_next"] - like(own, plain_signatures(following))) < 1e-12
        assert abs(r["near_edited"] - like(own, plain_signatures(edited))) < 1e-12


def test_spotsigs_takes_other_columns_and_long_texts(spark):
    long = "the cat sat on the mat of a big house " * 20_000
    docs = spark.createDataFrame([(1, long, "a", 1), (2, "x", "b", 2)], "doc_id long, text string, block string, packed int")
    found = {r["doc_id"]: r for r in spotsigs.neighbours(docs).collect()}
    assert found[1]["n_chars"] == len(long) and len(found) == 2


def test_spotsigs_query_against_a_loop(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    found = {r["doc_id"]: r for r in registry.op1_spotsigs(spark, SF).collect()}
    spots = spotsigs.Spots()
    for (doc, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, other = set(spots.signatures(text).tolist()), set(spots.signatures(edited).tolist())
        r = found[doc]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{s:08x}" for s in sorted(own))
        assert abs(r["near_edited"] - (len(own & other) / len(own | other) if own | other else 1.0)) < 1e-12


def test_spotsigs_rows(spark):
    docs = spark.createDataFrame([(3, None), (1, ""), (2, "the cat sat on the mat"), (None, "the cat sat on the mat"), (2, "x")], "doc_id long, text string")
    found = spotsigs.neighbours(docs).collect()
    assert len(found) == 5 and sum(r["fingerprint"] == "" for r in found) == 2
    assert spotsigs.neighbours(docs.where("doc_id > 9")).count() == 0
    alone = spotsigs.neighbours(docs.where("doc_id = 3")).first()
    assert (alone["n_chars"], alone["near_next"], alone["near_edited"]) == (0, 1.0, 1.0)


def test_spotsigs_chain():
    spots = spotsigs.Spots(chain=2)
    assert len(spots.signatures("the cat sat")) == 1 and len(spots.signatures("the cat")) == 1 and len(spots.signatures("... 。")) == 0
    assert (spots.signatures("the cat sat") == spots.signatures("The CAT, sat!")).all()
    assert (spots.signatures("the cat sat") != spots.signatures("a cat sat")).all()


def test_spotsigs_components_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    docs = []
    for i in range(30):
        text = rng.choice(words, 80).tolist()
        docs.append((3 * i, " ".join(text)))
        for k, edits in ((1, 1), (2, 12)):
            changed = list(text)
            for at in rng.integers(0, 80, edits):
                changed[at] = "zz"
            docs.append((3 * i + k, " ".join(changed)))
    spots = spotsigs.Spots()
    sets = {d: set(spots.signatures(t).tolist()) for d, t in docs}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = {r["doc_id"]: r["component_id"] for r in spotsigs.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert near and found == plain_components(sets, near)
