"""Rule ledger, URL filter, packing, SentencePiece and personal data against brute force."""

from __future__ import annotations

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from monthgrain.llm import packing, pii, quality_rules, sentencepiece_viterbi, textkernel, url_filter

WORD = r"[^\x20\x09-\x0D]+"


def thue_morse(n):
    """A word and its mirror: they collide under every polynomial modulo a power of two."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


A, B = thue_morse(1024)
ODD = [None, "", " \n\t ", "one", "a b", "é x é x é x", "x\n\nx\nx \n", "漢字 😀 " * 40, "w" * 30_000, "no $$$ & <b> " * 30, f"{A}\n{B}", f"{A} {B} {A} {A} {B}"]


def measured(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(WORD, line):
            dup += line in lines
            lines.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(again)


def test_ledger_measures_like_brute_force(docs):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab é\n#|A!") for _ in range(rng.randint(0, 150))) for _ in range(300)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = quality_rules.apply_policy(quality_rules.ledger(docs(texts))).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = measured(texts[row.doc_id])
        assert tuple(row[n] for n in names) == want, texts[row.doc_id]
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row.kept and row.base_failed)


def test_policies_and_ablation_read_bits_only(spark):
    rows = spark.createDataFrame([(1, 0), (2, 1), (3, 4), (4, 5), (5, 4)], "doc_id long, fail_bits long")
    assert {r.doc_id: r.kept for r in quality_rules.apply_policy(rows, "v1").collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}
    found = {r.rule: (r.n_failed, r.n_only, r.n_kept_without) for r in quality_rules.ablation(rows, "v2").collect()}
    assert found["few_words"] == (2, 1, 2)
    assert found["symbols"] == (3, 2, 3)
    assert found["upper_case"] == (0, 0, 1)


def test_ledger_of_an_empty_table(docs):
    assert quality_rules.ledger(docs([])).count() == 0


def judged(rules, host, path):
    fits = [(len(h + p), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (max(fits)[2], max(fits)[3]) if fits else (None, "allow")


@pytest.mark.parametrize("limit", [100_000, 1])
def test_urls_by_trie_and_by_join_like_brute_force(spark, limit):
    rules = [*url_filter.RULES, ("com", "/en", "block"), ("b.com", "", "allow"), ("b.com", "", "block"), ("net", "/fr/x/", "allow")]
    rng = random.Random(1)
    hosts = ["com", "b.com", "a.b.com", "B.COM", "example.com", "www.example.com", "xexample.com", "c.net", "net", "", "a..com"]
    paths = ["", "/", "/en/", "/en/1", "/english", "/fr/x/y", "/fr/", "//", "/es/?q#f", "?x=/en/", "#/en/"]
    urls = [None, "", "no scheme", "http:/a.com/"] + [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(200)]
    pages = spark.createDataFrame([(i % 50 or None, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    found = url_filter.judge(pages, spark.createDataFrame(rules, url_filter.RULE_SCHEMA), max_broadcast=limit)
    want = Counter()
    for i, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        want[(i % 50 or None, host.lower(), path, *judged(rules, host.lower(), path))] += 1
    assert Counter(map(tuple, found.collect())) == want


def test_packing_round_trip(docs):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["The", "it's", "Straße,", "x1.y2", "ÉÉ!", "<|endoftext|>", "a"]) for _ in range(rng.choice([3, 400, 6000]))) for _ in range(30)]
    frame = docs(texts, [None, *range(1, len(texts))]).repartition(3)
    pieces = packing.pack(frame, with_ids=True, shard_tokens=20_000).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p.ids)) and len(p.ids) == p.length
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert len(by_doc) == len(texts)
    for doc_id, own in by_doc.items():
        text = texts[doc_id or 0] or ""
        own.sort(key=lambda p: p.start)
        assert [i for p in own for i in p.ids] == tokenizer.encode(text, add_special_tokens=False).ids + [2]
        assert {p.doc_tokens for p in own} == {sum(p.length for p in own)}
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        size = sum(p.length for p in own)
        assert size == 4096 or size < 4096 and size & (size - 1) == 0  # no padding anywhere
    assert packing.pack(docs([])).count() == 0


def test_packing_balances_cost():
    import numpy as np

    lengths = np.array([4000, 4000, 50, 40, 30, 60, 3, 9])
    pieces = packing.place(lengths, 4096, 1.0, 1 / 4096)
    first = {doc: seq for doc, start, _, seq, _ in pieces if start == 0}
    assert first[0] != first[1]  # the two dear ones go apart
    assert sum(n for _, _, n, _, _ in pieces) == lengths.sum()


def best_path(pieces, text):
    form = sentencepiece_viterbi.SPACE + text.replace(" ", sentencepiece_viterbi.SPACE)
    score = dict(zip((pieces.texts[i] for i in pieces.ids.tolist()), pieces.scores.tolist()))
    number = {pieces.texts[i]: i for i in pieces.ids.tolist()}
    best = [(0.0, 0, None)] + [None] * len(form)
    for start in range(len(form)):
        for end in range(start + 1, min(len(form), start + pieces.longest) + 1):
            part = form[start:end]
            value = score.get(part, pieces.unknown if end == start + 1 else None)
            if value is not None and (best[end] is None or value + best[start][0] > best[end][0]):
                best[end] = (value + best[start][0], start, number.get(part))
    out, end = [], len(form)
    while end:
        _, start, piece = best[end]
        out.append([piece] if piece is not None else [int(pieces.byte_id[b]) for b in form[start:end].encode()])
        end = start
    return [i for part in reversed(out) for i in part]


def test_sentencepiece_against_brute_force_and_back(docs):
    import sentencepiece

    rng = random.Random(4)
    texts = [*ODD, "a" * 200_000, "漢" * 3000, "a  b", "   lead", "trail  ", "tab\there\nnl", "<s> </s> <0x41>", "ﬁ ™ x́"]
    texts += [" ".join("".join(rng.choice("abcdeflnostäß.,") for _ in range(rng.randint(1, 14))) for _ in range(25)) for _ in range(40)]
    coded = sentencepiece_viterbi.encode(docs(texts).withColumn("ids", F.lit("clash")))
    pieces = sentencepiece_viterbi.Pieces(sentencepiece_viterbi.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_viterbi.MODEL))
    for row in coded.collect():
        text = texts[row.doc_id]
        assert row.ids == (None if text is None else best_path(pieces, text) if text else [])
        if text:
            assert library.decode(row.ids) == text
    back = sentencepiece_viterbi.decode(coded.drop("text"))
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate(texts))
    assert sentencepiece_viterbi.encode(docs([])).count() == 0


def test_known_runs_grow_like_a_dictionary():
    import numpy as np

    rng = np.random.default_rng(6)
    held, want = textkernel.KnownRuns(np.int32), {}
    for block in range(60):
        keys = np.unique(rng.integers(0, 4000, 100).astype(np.uint64))
        new = held.find(keys)[1] < 0
        assert new.tolist() == [k not in want for k in keys.tolist()]
        count = rng.integers(0, 4, int(new.sum()))
        flat = rng.integers(0, 99, int(count.sum())).astype(np.int32)
        ends = np.cumsum(count)
        want.update((k, flat[e - n : e].tolist()) for k, e, n in zip(keys[new].tolist(), ends.tolist(), count.tolist()))
        held.add(keys[new], count, flat)
        which = rng.integers(0, len(keys), 50)
        begin, sizes = (column[which] for column in held.find(keys))
        assert held.expand(begin, sizes).tolist() == [i for k in keys[which].tolist() for i in want[k]]
        assert sizes.tolist() == [len(want[k]) for k in keys[which].tolist()]
    assert len(held) == len(want) and len(held.runs) < 12


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


BASE = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def base_spans(text):
    for kind, pattern in BASE:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            yield f"{kind}:{m.start()}:{m.end()}"


def test_personal_data_base_spans_like_brute_force(docs):
    rng = random.Random(5)
    parts = [*"a1.@-_ +9(0)é5\n😀4%", "4111111111111111", "5500005555555559", "1.2.3.4", "+49 30 123456-7", "me.x@site.co.uk", "- "]
    texts = [None, "", "a@b.c..d@e.f a@b.c_d@e.f", "a.@b.c", "1.2.3.4.5.6.7.8 1.2.300.4", "4111-1111-1111-1111", "1." * 5000, "1 " * 5000]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    rows = pii.report(docs(texts)).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = ",".join(base_spans(texts[row.doc_id]))
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[row.doc_id][:300]
        assert row.spans.startswith(want)
        assert row.n_email == want.count("email:") and row.n_card == want.count("card:")


def test_personal_data_adds_secrets_and_redacts(docs):
    secret = "4d44c79e8bf7c55759c4958dd60ed83d2ef8a1b0"
    texts = [f'word token = "{secret}" word, mail me.x@site.com' for _ in range(20)] + [None, "", "plain words " * 20]
    spans = {r.doc_id: r.spans for r in pii.report(docs(texts)).collect()}
    at = texts[0].index("me.x")
    assert spans[0] == f"email:{at}:{at + 13},secret:14:54" and spans[22] == ""
    clean = {r.doc_id: r.text for r in pii.redact(docs(texts)).collect()}
    assert clean[0] == 'word token = "<SECRET>" word, mail <EMAIL>'
    assert clean[20] is None and clean[21] == "" and clean[22] == texts[22]
    assert pii.redact(docs(texts)).columns == docs([]).columns


def test_reliabilities_follow_agreement():
    counts = {"secret|1|1|1|5|p|p": 90, "secret|-1|0|0|4|s|s": 200, "secret|1|0|0|5|s|s": 8, "secret|-1|1|-1|5|s|s": 4}
    belief = pii.estimate(counts)
    assert belief["secret|1|1|1"] > 0.99 and belief["secret|-1|0|0"] < 0.1
    assert json.dumps(pii.train({})) == "{}"
