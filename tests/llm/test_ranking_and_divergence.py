"""Ball-tree search, SimHash pigeonring and the divergence audit against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from monthgrain.llm import ball_tree, simhash_pigeonring as sp, source_divergence
from monthgrain.llm.work import Work

ODD = [None, "", " \n\t ", "one", "A a É é", "x" * 20_000, "漢字 😀 " * 30, "a\x00b", "same words here", "same words here"]


def prose(rng, n, alphabet="abcdefg"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3))) for _ in range(n))


def low(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# -- ranked search ----------------------------------------------------------------------------------------------------


def ranked(docs, items, k):
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    bags = [Counter(re.findall(term, low(t))) for _, t in docs]
    sizes = [sum(b.values()) for b in bags]
    number, total = sum(n > 0 for n in sizes), sum(sizes)
    df = Counter(t for b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), bag, n in zip(docs, bags, sizes):
            score = 0
            for t, repeats in Counter(re.findall(term, low(text))).items():
                if t in bag:
                    w = math.floor(1000 * math.log((2 * number + 2) / (2 * df[t] + 1)))
                    m = 75 + 25 * n * number // total
                    score += repeats * w * (10**9 * bag[t] // (1000 * bag[t] + 12 * m))
            if score > 0:
                scores.append((-score, doc is not None, doc or 0))
        out += [(item, i + 1, d if has else None, -s) for i, (s, has, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf, query_terms", [(2, 1 << 16), (64, 10)])
def test_search_like_brute_force(docs, spark, work, leaf, query_terms):
    rng = random.Random(5)
    texts = ODD + [prose(rng, rng.choice([1, 5, 40, 300])) for _ in range(150)]
    ids = [None, *rng.sample(range(1000), len(texts) - 1)]
    ids[-1] = ids[-2]  # a repeated id
    items = [(i, prose(rng, rng.randint(1, 25))) for i in range(12)] + [(3, "é same HERE"), (20, None), (21, "zzzz"), (22, texts[-1])]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score long")
    found = ball_tree.search(docs(texts, ids).repartition(3), asked, work, 7, leaf, query_terms)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == ranked(list(zip(ids, texts)), items, 7)


def test_search_of_empty_tables(docs, spark, work):
    none = spark.createDataFrame([], "item_id long, text string")
    assert ball_tree.search(docs(["a"]), none, work).count() == 0
    one = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ball_tree.search(docs([]), one, Work(spark, "no-docs")).count() == 0


def test_balls_hold_their_rows_and_bounds_hold_all_scores():
    rng = np.random.default_rng(2)
    dense = rng.integers(0, 10**6, (200, 30)) * (rng.random((200, 30)) < 0.2)
    dense[:, 0] = 5
    dense[50:60] = dense[50]
    begin = np.concatenate([[0], np.cumsum((dense > 0).sum(1))])
    rows = ball_tree.Rows(begin, np.nonzero(dense)[1], dense[dense > 0].astype(float))
    tree = ball_tree.BallTree(rows, 30, 4)
    queries = ball_tree.Queries([(0, 0), (1, 1)], np.array([0, 3, 4]), np.array([0, 4, 9, 2]), np.array([7, 11000, 3, 0]))
    assert sorted(tree.places.tolist()) == list(range(200)) and sum(c is None for c in tree.children) >= 50 // 2
    weight = np.zeros((2, 30))
    weight[0, [0, 4, 9]] = [7, 11000, 3]
    bound = tree.bounds(queries)
    for node, (a, b) in enumerate(tree.spans):
        own = dense[tree.places[a:b]]
        assert np.sqrt(((own - tree.centroid[node]) ** 2).sum(1)).max() <= tree.radius[node]
        assert ((own @ weight.T) <= bound[node]).all()


# -- fingerprints -----------------------------------------------------------------------------------------------------


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints):
    group = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("chain", [2, 3])
def test_near_fingerprints_like_brute_force(docs, work, chain):
    rng = random.Random(6)
    base = prose(rng, 200, "abcdefghijklmnop").split()
    texts = list(ODD)
    for _ in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = prose(rng, 1)
        texts.append(" ".join(own))
    texts += [prose(rng, rng.randint(1, 30)) for _ in range(40)]
    ids = rng.sample(range(1000), len(texts))
    prints = [fingerprint(t) for t in texts]
    group = grouped(prints)
    least = {g: min(i for i, h in zip(ids, group) if h == g) for g in group}
    rows = sp.near_duplicates(docs(texts, ids).repartition(3), work, chain=chain).collect()
    want = {i: (f"{p:016x}", least[g]) for i, p, g in zip(ids, prints, group)}
    assert len(rows) == len(texts) and {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == want


@pytest.mark.parametrize("chain, block", [(2, 2048), (2, 16), (3, 64)])
def test_links_of_crowded_fingerprints(spark, work, chain, block):
    """Hundreds of fingerprints share their first bits: one hot key, dealt into blocks; some are exactly 4 and 5 bits apart."""
    rng = random.Random(7)
    prints = {0, (1 << 64) - 1}
    centre = rng.getrandbits(64)
    for _ in range(300):
        prints.add(centre ^ sum(1 << b for b in rng.sample(range(30, 64), rng.randint(0, 8))))
    for _ in range(60):
        one = rng.getrandbits(64)
        prints |= {one, one ^ sum(1 << b for b in rng.sample(range(64), 4)), one ^ sum(1 << b for b in rng.sample(range(64), 5))}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = sp.links(spark.createDataFrame([(p,) for p in signed], "fp long"), work, chain, block).collect()
    place = {p: i for i, p in enumerate(signed)}
    group = list(range(len(prints)))
    for r in found:
        assert ((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() >= 1
        old, new = group[place[r.a]], group[place[r.b]]
        group = [new if g == old else g for g in group]
    want = grouped(prints)
    assert len(set(zip(group, want))) == len(set(group)) == len(set(want))


def test_fingerprints_of_empty_tables_and_missing_ids(docs, spark, work):
    assert sp.near_duplicates(docs([]), work).count() == 0
    rows = sp.near_duplicates(docs(["a b", "a b", "c", None], [None, 4, None, None]), Work(spark, "bare")).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in rows) == [("4", "4"), ("None", "4"), ("None", "None"), ("None", "None")]


# -- divergence -------------------------------------------------------------------------------------------------------


def audited(rows, top):
    bags = [(lang or "", source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text)))) for text, lang, source in rows]
    out = []
    for lang in {b[0] for b in bags}:
        df = Counter(t for b in bags if b[0] == lang for t in b[2])
        kept = sorted((t for t in df if df[t] >= 3), key=lambda t: t.encode())
        sums = defaultdict(Counter)
        for b in bags:
            if b[0] == lang:
                sums[b[1]].update({t: n for t, n in b[2].items() if df[t] >= 3})

        def shares(count):
            total = sum(count.values()) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        whole = shares(sum(sums.values(), Counter()))
        p = {s: shares(c) for s, c in sums.items()}
        for s in sums:
            far = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o) for o in sums if o != s]
            own = [(-((p[s][t] - whole[t]) ** 2 // whole[t]), t) for t in kept if sums[s][t] and p[s][t] > whole[t]]
            for part, found, most in (("pair", far, len(far)), ("term", own, top)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found[:most])]
    return sorted(out)


@pytest.mark.parametrize("most", [1 << 20, 8])
def test_audit_like_brute_force(spark, work, most, monkeypatch):
    monkeypatch.setattr(source_divergence, "TERMS", most)  # 8: many shards and passes
    rng = random.Random(9)
    rows = [(t, "xx", "odd") for t in ODD]
    for i in range(160):
        source = "hot" if i % 3 == 0 else f"s{rng.randint(0, 5)}"
        rows.append((prose(rng, rng.choice([0, 3, 60]), "abcÉ"), rng.choice(["en", "en", "de", None]), source))
    rows += [("alone words", "solo", None), ("three", "solo", "x"), ("", "none", "a"), (None, "none", "b")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, source string, value long").repartition(3)
    found = source_divergence.audit(frame, work, top=9)
    assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, found.collect())) == audited(rows, 9)


def test_vectorizers_are_dealt_by_the_terms_of_all_documents(spark, monkeypatch):
    """Copies of one text fall on the same side of any sample by hash; their terms count all the same."""
    monkeypatch.setattr(source_divergence, "TERMS", 10)
    kept = [" ".join(f"{w}{'abcdefghij'[i]}" for w in ("x", "yy", "zzz", "vvv") for i in range(10)) for _ in range(3)]
    for own in range(12):
        texts = [f"{t} {'q' * (own + 1)}" for t in kept] + ["rare one", "rare two"]
        rows = spark.createDataFrame([(0, t) for t in texts] + [(1, "few few few"), (1, "few"), (1, "few Few")], "lang_no int, text string")
        assert source_divergence._shards(rows) == {0: 1 + int(41 * 1.1) // 10, 1: 1}


def test_block_counts_like_brute_force(spark):
    """One pass counts the occurrences of a term in a group and the documents that hold it."""
    rng = random.Random(10)
    rows = [(i % 2, i % 4, prose(rng, rng.choice([0, 2, 40]), "abcÉ")) for i in range(60)] + [(0, 2, t) for t in ODD]
    n, df = Counter(), Counter()
    for lang, group, text in rows:
        terms = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text)))
        n.update({(lang, group, t): k for t, k in terms.items()})
        df.update((lang, group, t) for t in terms)
    frame = spark.createDataFrame(rows, "lang_no int, group long, text string").repartition(3)
    found = source_divergence._counts(frame).collect()
    assert {(r.lang_no, r.group, r.item): (r.n, r.df) for r in found} == {k: (n[k], df[k]) for k in n} and len(found) == len(n)


def test_audit_scans_the_texts_once(spark, work, monkeypatch):
    """The vectorizers are fitted on the counted terms, however many there are."""
    monkeypatch.setattr(source_divergence, "TERMS", 3)
    read = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda t: read.add(1) or t, "string").asNondeterministic()
    rows = [(" ".join(f"{w}{'abcdefghij'[i]}" for i in range(10)), lang, s) for w, lang in (("x", "en"), ("y", "de")) for s in "abc"]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("text", seen("text"))
    found = source_divergence.audit(frame, work).collect()
    assert sorted(map(tuple, found)) == audited(rows, 200)
    assert read.value == len(rows)


def test_audit_of_an_empty_table(spark, work):
    assert source_divergence.audit(spark.createDataFrame([], "text string, lang string, source string"), work).count() == 0
