"""Operators over the whole corpus against brute force, and the pipeline."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthgrain.llm import kneser_ney, minhash_dedup, nn_descent, suffix_dedup, warc
from monthgrain.llm.components import components
from monthgrain.llm.induced_sort import repeated_positions
from monthgrain.llm.work import Work

SYLLABLES = "an be co du el fi go ha it jo ka lu mi no op pa".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def changed(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


# -- archives ---------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark, work):
    long = "<p>" + "é" * 120
    tricky = "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello" * 5
    rows = [(5, "http://a/x", long), (3, "http://a/y z\r\n", long), (9, None, long), (None, "http://n", long), (7, "u", "short"), (8, "u", "short")]
    rows += [(11, "http://t", tricky), (12, "http://t", tricky), (20, "", None), (21, "x", ""), (3, "http://a/y z\r\n", long), (30, "h", "z" * 99), (31, "h", "z" * 99)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int")
    found = warc.captures(pages, work, records_per_file=7)
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter()
    for page, _, html in rows:
        first = min(p for p, _, h in rows if h == html and p is not None)
        again = len((html or "").encode()) >= 100 and page is not None and page != first
        want[(page, len((html or "").encode()), digest(html), "revisit" if again else "response", first if again else None)] += 1
    got = found.collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    for r in got:
        assert r.request.headers[""].startswith("GET /") and r.metadata is not None
        if r.record_type == "response":
            assert hashlib.sha256(r.response.payload).hexdigest() == r.payload_digest


def test_archives_of_an_empty_table(spark, work):
    assert warc.captures(spark.createDataFrame([], "page_id long, url string, html string"), work).count() == 0


def test_transactions_join_in_either_direction(spark):
    rows = [
        ("r1", "response", ["q1"], None),
        ("q1", "request", [], None),
        ("m1", "metadata", ["q1"], None),
        ("r2", "response", [], None),
        ("q2", "request", ["r2"], None),
        ("m2", "metadata", ["r2"], None),
        ("r3", "response", [], None),
    ]
    full = [(*r, "u", {"a": "b"}, 1, "d", None) for r in rows]
    nested = warc.assemble(spark.createDataFrame(full, warc.RECORD_SCHEMA)).collect()
    parts = {r.record_id: (r.request and r.request.record_id, r.metadata and r.metadata.record_id) for r in nested}
    assert parts == {"r1": ("q1", "m1"), "r2": ("q2", "m2"), "r3": (None, None)}


# -- neighbours -------------------------------------------------------------------------------------------------------


def test_neighbours_reach_recall(spark, work):
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((12, 24))
    vectors = [(centers[i % 12] + 0.4 * rng.standard_normal(24)).astype(np.float32).tolist() for i in range(1200)]
    vectors[300:700] = [vectors[0]] * 400  # a third of the rows hold one vector
    rows = list(enumerate(vectors)) + [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] * 24), (None, vectors[1]), (7, vectors[7]), (5300, [1.0])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, node string")
    found = nn_descent.search(frame, F.col("id") % 100 == 0, work).collect()
    matrix = np.array(vectors, np.float32).astype(float)
    hits = total = 0
    for q in range(0, 1200, 100):
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        far = np.sqrt(((matrix - matrix[q]) ** 2).sum(1))
        far[q] = np.inf
        best = np.lexsort((np.arange(1200), far))[:10]
        assert [r.rank for r in own] == list(range(1, 11))
        assert np.allclose([r.score for r in own], far[[r.vec_id for r in own]], rtol=0, atol=1e-12)
        assert [(r.score, r.vec_id) for r in own] == sorted((r.score, r.vec_id) for r in own)
        hits, total = hits + len({r.vec_id for r in own} & set(best.tolist())), total + 10
    assert {r.query_id for r in found} == set(range(0, 1200, 100))
    assert hits / total >= 0.9


@pytest.mark.parametrize("noise, outlier", [(1e-5, 1.0), (1e-3, 1e7)])
def test_neighbours_of_near_equal_vectors(spark, work, noise, outlier):
    """A third of the rows nearly equal, and one huge component."""
    rng = np.random.default_rng(1)
    matrix = rng.standard_normal((1200, 24))
    matrix[400:800] = matrix[400] * (1 + noise * rng.standard_normal((400, 24)))
    matrix[1, 3] = outlier
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    found = nn_descent.search(frame, F.col("id") % 50 == 0, work).collect()
    near, others = [], []
    for q in range(0, 1200, 50):
        far = np.sqrt(((matrix - matrix[q]) ** 2).sum(1))
        far[q] = np.inf
        best = np.lexsort((np.arange(1200), far))[:10]
        (near if 400 <= q < 800 else others).append(len({r.vec_id for r in found if r.query_id == q} & set(best.tolist())))
    assert np.mean(near) >= 9 and np.mean(others) >= 9, (np.mean(near), np.mean(others), near, others)


def test_neighbours_of_vectors_without_clusters(spark, work):
    """Random vectors of many dimensions, nearly equally far from each other: a narrow walk misses more than one in ten."""
    n = 4000
    matrix = np.random.default_rng(3).standard_normal((n, 400)).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<float>")
    found = nn_descent.search(frame, F.col("id") % 100 == 0, work).collect()
    exact, hits = matrix.astype(float), []
    for q in range(0, n, 100):
        far = ((exact - exact[q]) ** 2).sum(1)
        far[q] = np.inf
        hits.append(len({r.vec_id for r in found if r.query_id == q} & set(np.argsort(far)[:10].tolist())))
    assert np.mean(hits) >= 9.5, hits


def test_walk_measures_a_part_of_the_nodes(spark, work, monkeypatch):
    """Where near vectors are linked, a query finds its neighbours without measuring a third of the table."""
    n = 4000
    matrix = np.random.default_rng(4).standard_normal((n, 4))
    nodes = work.save(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "node long, vec array<double>"), "nodes")
    graph = nn_descent.build(nodes, work, nn_descent.Settings())
    monkeypatch.setattr(work, "drop", lambda *names: None)
    starts = spark.createDataFrame([(q,) for q in range(0, n, 200)], "q long")
    found = nn_descent.walk(starts, nodes, graph, work, nn_descent.Settings(), 11).collect()
    hits = []
    for q in range(0, n, 200):
        far = ((matrix - matrix[q]) ** 2).sum(1)
        hits.append(len({r.node for r in found if r.q == q} & set(np.argsort(far)[:11].tolist())))
    assert np.mean(hits) >= 10.9, hits
    step = 0
    while os.path.isdir(work.path(f"walk-{step + 1}").removeprefix("file:")):
        step += 1
    measured = spark.read.parquet(work.path(f"walk-{step}")).count()
    assert measured / 20 <= n / 3


def test_walk_measures_a_part_of_the_pairs(spark, work, monkeypatch):
    """As above, counting what each query has met, on the exact graph; a node is in the list of a query once."""
    n = 4000
    matrix = np.random.default_rng(4).standard_normal((n, 4))
    far = np.sqrt(((matrix[:, None] - matrix[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, axis=1)[:, :28]
    nodes = work.save(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "node long, vec array<double>"), "nodes")
    graph = spark.createDataFrame([(i, int(j), float(far[i, j])) for i in range(n) for j in near[i]], "u long, v long, d double")
    monkeypatch.setattr(work, "drop", lambda *names: None)
    starts = spark.createDataFrame([(q,) for q in range(0, n, 200)], "q long")
    found = nn_descent.walk(starts, nodes, graph, work, nn_descent.Settings(), 11).collect()
    np.fill_diagonal(far, 0)
    assert {(r.q, r.node) for r in found} == {(q, int(j)) for q in range(0, n, 200) for j in np.argsort(far[q])[:11]}
    step = 0
    while os.path.isdir(work.path(f"walk-{step + 1}").removeprefix("file:")):
        step += 1
    lists = [np.frombuffer(r.q, np.int32) for r in spark.read.parquet(work.path(f"walk-{step}")).collect()]
    assert all(len(x) == len(set(x.tolist())) for x in lists)
    assert 11 <= sum(map(len, lists)) / 20 <= n / 3


def test_search_keeps_no_row_for_a_link(spark, work, monkeypatch):
    """Links and what queries meet travel as arrays of blocks: no working table has more rows than there are vectors."""
    n, rows, save = 600, {}, work.save

    def counted(df, name):
        saved = save(df, name)
        rows[name] = saved.count()
        return saved

    monkeypatch.setattr(work, "save", counted)
    matrix = np.random.default_rng(6).standard_normal((n, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(matrix)], "vec_id long, embedding array<double>")
    found = nn_descent.search(frame, F.col("id") % 100 == 0, work).collect()
    for q in range(0, n, 100):
        far = np.sqrt(((matrix - matrix[q]) ** 2).sum(1))
        assert {r.vec_id for r in found if r.query_id == q} == set(np.argsort(far)[1:11].tolist())
    assert max(rows.values()) <= n, rows


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, work, n):
    frame = spark.createDataFrame([(100 * i, [float(i), 1.0]) for i in range(n)], "vec_id long, embedding array<float>")
    found = nn_descent.search(frame, F.col("id") % 100 == 0, work).collect()
    assert len(found) == n * (n - 1)


# -- repeated bytes ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("memory", [1 << 20, 0])
def test_induced_sort_finds_repeats(memory):
    rng = random.Random(1)
    for _ in range(25):
        letters, depth = rng.choice([1, 2, 3, 20]), rng.choice([1, 2, 5, 20])
        text = [rng.randint(2, 1 + letters) for _ in range(rng.randint(1, 120))]
        text = text + [1] + text[: rng.randint(0, 60)]
        count = Counter(tuple(text[i : i + depth]) for i in range(len(text) - depth + 1))
        want = [i + depth <= len(text) and count[tuple(text[i : i + depth])] > 1 for i in range(len(text))]
        assert repeated_positions(np.array(text, np.uint16), depth, memory).tolist() == want


def cut_like_brute_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    for t in raw:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        spans = sum(hit[i] and not (i and hit[i - 1]) for i in range(len(t)))
        kept = bytes(b for b, h in zip(t, hit) if not h)
        yield len(t), sum(hit), spans, hashlib.sha256(kept).hexdigest()


def repeated_texts():
    rng = random.Random(6)
    passage, other = prose(rng, 90), prose(rng, 45)
    texts = [None, "", "short", "é" * 400, passage, passage, "x" * 199, "x" * 200, "y" * 1000]
    for i in range(60):
        cut = rng.randint(0, 200)
        texts.append(f"{prose(rng, 30)}{passage[cut : cut + 330]}{prose(rng, rng.randint(0, 40))}")
        texts.append(prose(rng, 80) + (other if i % 3 else other[:198]) + ("à" if i % 2 else ""))
    return texts


def test_repeated_bytes_like_brute_force(docs, work):
    texts = repeated_texts()
    want = list(cut_like_brute_force(texts, 200))
    ids = [None if i == 4 else i for i in range(len(texts))]
    for row in suffix_dedup.report(docs(texts, ids).repartition(4), work).collect():
        assert tuple(row)[1:] == want[4 if row.doc_id is None else row.doc_id]


def test_repeated_rows_and_cut_texts(docs, work):
    text = prose(random.Random(7), 60)
    frame = docs([text, text, "ab" + "é" * 100 + "c", "b" + "é" * 100], [1, 1, 2, 3])
    clean = suffix_dedup.deduplicate(frame, work)
    assert clean.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in clean.collect()) == [(1, ""), (1, ""), (2, "ac"), (3, "")]
    assert suffix_dedup.deduplicate(docs([]), Work(work.spark, "empty")).count() == 0


# -- near copies ------------------------------------------------------------------------------------------------------


def grouped_like_brute_force(texts, ids, size, percent):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set()))
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min(ids[k] for k in range(len(ids)) if group[k] == g) for g in group}
    return [(len(s), least[g]) for s, g in zip(sets, group)]


def near_texts():
    rng = random.Random(8)
    line, base = prose(rng, 14), prose(rng, 120)
    texts = [None, "", "one", "One", "a b", "A  b", "x" * 20_000]
    texts += [changed(rng, base, rng.randint(0, 4)) for _ in range(60)]  # near copies
    texts += [f"{line} {prose(rng, rng.randint(1, 4))}" for _ in range(60)]  # a very common line in short texts
    texts += [changed(rng, prose(random.Random(i % 20), 60), rng.randint(0, 3)) for i in range(60)]
    return texts


@pytest.mark.parametrize("small, block", [(32, 256), (1, 4)])
@pytest.mark.parametrize("settings", [minhash_dedup.CONTRACT, minhash_dedup.DEFAULT])
def test_near_copies_like_brute_force(docs, work, settings, small, block, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "SMALL", small)
    monkeypatch.setattr(minhash_dedup, "BLOCK", block)
    texts = near_texts()
    ids = random.Random(1).sample(range(1000), len(texts))
    want = dict(zip(ids, grouped_like_brute_force(texts, ids, settings.shingle, settings.percent)))
    rows = minhash_dedup.near_duplicates(docs(texts, ids).repartition(4), work, settings).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert ((r.n_shingles, r.component_id), r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_many_copies_just_under_the_threshold_like_brute_force(docs, work):
    """500 texts whose pairs lie around the threshold: blocks verify them all, and no pair is missed."""
    rng = random.Random(12)
    base = prose(rng, 90).split()
    texts = []
    for _ in range(500):
        own = list(base)
        for at in rng.sample(range(90), rng.choice([1, 2, 2, 3])):
            own[at] = f"w{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
    ids = rng.sample(range(10_000), len(texts))
    want = dict(zip(ids, grouped_like_brute_force(texts, ids, 3, 85)))
    rows = minhash_dedup.near_duplicates(docs(texts, ids).repartition(4), work, minhash_dedup.CONTRACT).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == want


def test_overlaps_count_shared_shingles():
    rng = np.random.default_rng(3)
    sets = [set(rng.integers(0, 9000, rng.integers(1, 6000)).tolist()) for _ in range(9)]
    member = np.concatenate([np.full(len(s), i) for i, s in enumerate(sets)])
    shared = minhash_dedup.overlaps(member, np.concatenate([np.array(sorted(s)) for s in sets]), len(sets))
    assert all(shared[i, j] == len(a & b) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)


def test_texts_of_long_mirrored_words_are_not_linked(docs, work):
    word = "a"
    while len(word) < 2048:
        word += word.translate(str.maketrans("ab", "ba"))
    mirror = word.translate(str.maketrans("ab", "ba"))
    rows = minhash_dedup.near_duplicates(docs([word, mirror, f"x {word} y", f"x {mirror} y"]), work, minhash_dedup.CONTRACT)
    assert sorted((r.doc_id, r.component_id) for r in rows.collect()) == [(i, i) for i in range(4)]


def test_one_of_each_group_stays(docs, work):
    text = prose(random.Random(9), 40)
    frame = docs([text, text, text, "", None, "other", "other", text + " end"], [4, 4, None, 7, 8, None, None, 9])
    clean = minhash_dedup.deduplicate(frame, work)
    assert clean.columns == frame.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == [(0, "other"), (4, text), (7, ""), (8, "")]
    assert minhash_dedup.deduplicate(docs([]), Work(work.spark, "empty")).count() == 0


def test_estimate_is_corrected_for_collisions():
    rng = np.random.default_rng(0)
    one, two = (rng.integers(0, 1 << 63, 4000).astype(np.uint64) * np.uint64(2) for _ in range(2))
    for shared in (0, 2000, 3600):
        sides = [np.sort(np.concatenate([one[:shared], x[shared:]])) for x in (one, two)]
        rows = [minhash_dedup.sketch(np.zeros(4000, np.int64), s, 1, 1024) for s in sides]
        near, _ = minhash_dedup.estimate(*rows, np.array([4000]), np.array([4000]))
        assert abs(near[0] - shared / (8000 - shared)) < 0.06


def test_components_of_a_long_chain(spark, work):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (None, 3), (101, 100)]
    found = components(spark.createDataFrame(links, "a long, b long"), work)
    assert {r.node: r.label for r in found.collect()} == {i: 0 for i in range(1, 41)} | {101: 100}


def test_walk_measures_no_node_twice(spark, work, monkeypatch):
    """What a walk has met stays in its table, also beyond the beam, so that it is not met anew."""
    n, line = 12, [(i, [float(i + 1), 1.0]) for i in range(12)]
    nodes = spark.createDataFrame(line, "node long, vec array<double>")
    graph = spark.createDataFrame([(i, j, float(abs(i - j))) for i in range(n) for j in range(n) if 0 < abs(i - j) < 4], "u long, v long, d double")
    monkeypatch.setattr(work, "drop", lambda *names: None)
    starts = spark.createDataFrame([(5,)], "q long")
    found = nn_descent.walk(starts, nodes, graph, work, nn_descent.Settings(k=6, beam=3), 3).collect()
    assert {(r.node, r.score) for r in found} == {(5, 0.0), (4, 1.0), (6, 1.0)}
    met, step = set(), 0
    while os.path.isdir(work.path(f"walk-{step}").removeprefix("file:")):
        rows = [r.node for r in spark.read.parquet(work.path(f"walk-{step}")).collect()]
        assert met <= set(rows) and len(rows) == len(set(rows))
        met, step = set(rows), step + 1
    assert step > 2 and len(met) > 3


# -- language model ---------------------------------------------------------------------------------------------------


def test_model_probabilities_add_up(spark, work):
    """Given any context, the probabilities of all symbols sum to one."""
    rng = random.Random(10)
    codes = Counter(rng.choice([1, 1, 2, 3]) << 6 | rng.choice([1, 2, 2, 3, 4]) for _ in range(400))
    rows = [(a << 6 | b, codes.get(a << 6 | b, 0)) for a in range(64) for b in range(64)]
    model = kneser_ney.train(spark.createDataFrame(rows, "code long, n long"), work, order=2).collect()
    total = Counter()
    for r in model:
        total[r.code >> 6] += np.exp(r.logp)
    assert len(total) == 64 and all(abs(v - 1) < 1e-4 for v in total.values())


def test_classifier_parts_prose_from_noise(spark, work):
    rng = random.Random(11)
    rows = [(i, prose(rng, 80), "en") for i in range(100)] + [(100 + i, "".join(rng.choices("#$qxzXQ%&", k=300)), "en") for i in range(20)]
    rows += [(200, None, "en"), (201, "", None), (202, prose(rng, 50), None), (None, prose(rng, 50), "xx")]
    frame = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 100, 2)] + [(100, 0), (None, 1), (0, 1)], "doc_id long, quality int")
    found = {r.doc_id: r for r in kneser_ney.score(frame, labels, work, quantile=1.0).collect()}
    assert len(found) == len(rows)
    assert sum(found[i].kept for i in range(100)) >= 95 and not any(found[100 + i].kept for i in range(20))
    assert not found[200].kept and found[200].perplexity is None and found[202].threshold == found[0].threshold


def test_classifier_threshold_is_a_quantile_of_held_out_text(spark, work):
    rng = random.Random(11)
    rows = [(i, prose(rng, 80), "en") for i in range(60)] + [(100 + i, "".join(rng.choices("#$qxzXQ%&", k=300)), "en") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trusted = range(0, 60, 2)
    labels = spark.createDataFrame([(i, 1) for i in trusted] + [(100, 0)], "doc_id long, quality int")
    found = {r.doc_id: r for r in kneser_ney.score(frame, labels, work, quantile=1.0).collect()}
    assert found[0].threshold == max(found[i].perplexity for i in trusted)
    # trusted text is measured like any other: the model that measures it has not seen it
    seen, new = (np.mean([found[i].perplexity for i in range(first, 60, 2)]) for first in (0, 1))
    assert abs(seen / new - 1) < 0.02
    assert sum(found[i].kept for i in range(60)) >= 55 and not any(found[100 + i].kept for i in range(20))


def test_ngrams_keep_code_points_apart():
    many = "".join(map(chr, range(0x100, 0xD000)))
    texts = ["aé€😀b", "", "Привет\x00", "漢字かな", many + many[::-1], "xyz"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])
    found = []
    for code, owner, alphabet in kneser_ney.ngrams(data, offsets, 4):
        found += zip(*(x.tolist() for x in (*kneser_ney.parts(code, alphabet, 4), owner)))
    expected = []
    for i, t in enumerate(texts):
        c = [kneser_ney.PAD] * 3 + [ord(x) for x in t]
        expected += [(c[j] << 42 | c[j + 1] << 21 | c[j + 2], c[j + 3], i) for j in range(len(t))]
    assert found == expected


@pytest.mark.parametrize("first", [0x430, 0x4E00])
def test_classifier_parts_prose_from_noise_in_other_scripts(spark, work, first):
    """Noise of the same letters and word lengths; only which letter follows which tells them apart."""
    rng = random.Random(12)
    letters = [chr(first + i) for i in range(30)]
    words = ["".join(rng.choices(letters, k=6)) for _ in range(25)]
    good = lambda: " ".join(rng.choices(words, k=60))
    bad = lambda: " ".join("".join(rng.choices(letters, k=6)) for _ in range(60))
    rows = [(i, good(), "xx") for i in range(60)] + [(100 + i, bad(), "xx") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 2)], "doc_id long, quality int")
    found = {r.doc_id: r for r in kneser_ney.score(frame, labels, work, quantile=1.0).collect()}
    assert sum(found[i].kept for i in range(60)) >= 55 and not any(found[100 + i].kept for i in range(20))


def test_packed_texts_come_back(docs):
    """The exchange of the texts holds compressed runs of them; every row comes back once."""
    rng = random.Random(13)
    texts = [None, "", "é😀" * 50_000] + [prose(rng, 6000) for _ in range(40)]
    frame = docs(texts).select("doc_id", "text").repartition(2)
    packs = frame.mapInArrow(kneser_ney._packed, "task long, no long, texts binary").toArrow()
    assert len(set(zip(packs["task"].to_pylist(), packs["no"].to_pylist()))) == packs.num_rows > 2
    back = [r for batch in kneser_ney._unpacked(packs) for r in batch.to_pylist()]
    assert sorted((r["doc_id"], r["text"]) for r in back if r["doc_id"]) == list(enumerate(texts))[1:] and len(back) == len(texts)
    held = sum(len(t.encode()) for t in texts if t)
    assert sum(len(t) for t in packs["texts"].to_pylist()) < 0.7 * held


def test_classifier_without_trusted_text(docs, spark, work):
    frame, labels = docs(["a b c", None]), spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in kneser_ney.score(frame, labels, work).collect()] == [True, True]
    assert kneser_ney.score(docs([]), labels, Work(spark, "empty")).count() == 0


# -- pipeline ---------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    passage = prose(rng, 70)
    clean = [prose(rng, 120) for _ in range(6)]
    texts = [*clean, changed(rng, clean[0], 1), "short", "$$$ " * 100, None, f"{prose(rng, 80)} {passage}", f"{prose(rng, 90)} {passage}"]
    texts.append(f"{prose(rng, 70)} me.x@site.com {prose(rng, 10)}")
    rows = [(i, t, "en", "s", len(t or ""), 1) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words int"
    docs = spark.createDataFrame(rows, schema)
    seen = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        columns = docs.columns
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert name == "packing" or docs.columns == columns
        seen[name] = {r.doc_id: r for r in docs.collect()}
    assert set(seen["quality_rules"]) == {*range(7), 10, 11, 12} and seen["quality_rules"][0].n_words == 1
    assert set(seen["minhash_near_dedup"]) == {*range(6), 10, 11, 12}
    left = seen["suffix_array_dedup"]
    assert all(left[i].text == texts[i] for i in range(1, 6)) and passage[5:-5] not in left[10].text + left[11].text
    assert left[10].n_chars == len(left[10].text)
    assert "<EMAIL>" in seen["pii"][12].text and "@" not in seen["pii"][12].text
    assert set(seen["packing"]) == set(seen["pii"])
    assert pipeline.ORACLE_SQL is None
