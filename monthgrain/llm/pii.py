"""Personal data by weak supervision, with DataFrame functions only.

Candidates are the base patterns (email, ip, card, phone) and looser ones (secrets, national phone numbers, spelt-out emails).
Three labelers vote on each candidate, for, against or abstaining: its shape (regex), a gazetteer (top-level domains, calling
codes, issuer prefixes, key words) and the words before it (context).  Expectation-maximisation over the table of vote
patterns (at most 27 per kind) estimates how reliable each labeler is without any truth; its posteriors train a naive Bayes
span classifier over votes and shape features.  Base spans always stay; a loose one is added when the classifier accepts it.

The text is scanned twice: once for the counts of feature combinations, combined map-side and bounded by their product, and
once to apply the accepted combinations as literals.  Nothing is shuffled but those counts.

The base patterns are written so that the JVM needs neither recursion nor quadratic search on long runs: a character that may
not be part of a match is first replaced by another of equal length, then plain character classes suffice; a match may start
only where no earlier start in the same run could have matched.

Defined results: a null or empty text has no spans; null ids, repeated rows and ties are kept; an empty table gives no rows;
overlapping spans of different kinds are all listed (a loose span that touches a base span is dropped); columns of the input with
other names play no part.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F

#: Kinds in the order of results; the first four are the base.
BASE = ("email", "ip", "card", "phone")
LOOSE = ("secret", "national_phone", "spelt_email")
KINDS = (*BASE, *LOOSE)

_LOCAL = "A-Za-z0-9._%+-"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# on a text whose dots that end no label are replaced by "_"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# on a text whose separators that join no two digits are replaced by "_": a run of digits and separators is one match
_CARD = r"(?<![0-9 -])[0-9 -]{13,37}+(?![0-9 -])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SECRET = r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+"
_NATIONAL = r"(?<![0-9+(])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
_SPELT = (
    rf"(?<![{_LOCAL}])[{_LOCAL}]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++"
    r"(?:(?: ?[\[(](?:dot|DOT)[\])] ?|\.)[A-Za-z0-9-]++){1,4}"
)

#: Gazetteers and context words: fixed values.
TOP_LEVEL = "com|org|net|edu|gov|info|biz|io|de|fr|es|it|uk|eu|us|ca|ch|at|nl|be|pl|se|jp|cn|in|br|au"
CALLING_CODES = "1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
ISSUERS = "3[47]|4|5[1-5]|2[2-7]|6"
KEY_WORDS = "token|secret|password|passwd|api[_ -]?key|key|auth|bearer|credential"
CONTEXT = {
    "email": "e-?mail|mail|contact|write|@|von|from|to",
    "ip": "ip|host|server|address|addr|ping|login|from",
    "card": "card|visa|master|credit|kredit|carte|tarjeta|pay|number|no",
    "phone": "phone|tel|call|mobile|fax|contact|telefon|teléfono|ring",
    "secret": KEY_WORDS,
    "national_phone": "phone|tel|call|mobile|fax|contact|telefon|teléfono|ring",
    "spelt_email": "e-?mail|mail|contact|write|von|from|to",
}
AGAINST = "version|release|section|chapter|isbn|doi|commit|sha-?[0-9]*|md5|order|figure"
CONTEXT_CHARS = 24
BLOCK = 128
ROUNDS = 50
#: Right and wrong votes that each labeler is credited with beforehand.
ACCURACY = (8.0, 2.0)


def _none() -> Column:
    """No spans: place, text, what stands before and the character after."""
    empty = F.struct(*(F.lit(0).alias(n) for n in ("s", "e")), *(F.lit("").alias(n) for n in ("hit", "before", "after")))
    return F.filter(F.array(empty), lambda x: x["s"] < 0)


def _located(text: Column, pattern: str) -> Column:
    """Code-point spans of the leftmost non-overlapping matches: what lies between them gives their places.

    Places are running sums, taken in blocks of ``BLOCK`` matches so that arrays grown by appending stay short.
    """

    def length(z: Column) -> Column:
        return F.length(z["gap"]) + F.length(F.coalesce(z["hit"], F.lit("")))

    def step(done: Column, z: Column) -> Column:
        start, end = done["at"] + F.length(z["gap"]), done["at"] + length(z)
        before, after = F.right(z["gap"], F.lit(CONTEXT_CHARS)), F.left(F.coalesce(z["next"], F.lit("")), F.lit(1))
        hit = F.coalesce(z["hit"], F.lit(""))
        one = F.struct(start.alias("s"), end.alias("e"), hit.alias("hit"), before.alias("before"), after.alias("after"))
        new = F.when(z["hit"].isNotNull(), F.array(one)).otherwise(_none())
        return F.struct(end.alias("at"), F.concat(done["found"], new).alias("found"))

    def spans(block: Column) -> Column:
        start = F.struct(block["at"].alias("at"), _none().alias("found"))
        return F.aggregate(block["pairs"], start, step, lambda done: done["found"])

    def placed(pairs: Column) -> Column:
        count = F.floor((F.size(pairs) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
        held = lambda at, block: F.array(F.struct(at.alias("at"), block.alias("pairs")))
        begin = F.struct(F.lit(0).alias("at"), F.filter(held(F.lit(0), pairs), lambda x: x["at"] < 0).alias("out"))
        total = lambda block: F.aggregate(block, F.lit(0), lambda n, z: n + length(z))
        more = lambda done, block: F.struct(
            (done["at"] + total(block)).alias("at"), F.concat(done["out"], held(done["at"], block)).alias("out")
        )
        return F.flatten(F.transform(F.aggregate(blocks, begin, more, lambda done: done["out"]), spans))

    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, 2, F.size(gaps)).alias("next"))
    return F.transform(F.array(pairs), placed)[0]  # bound to a lambda variable, so that it is evaluated once


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        v = F.ascii(back.substr(i, F.lit(1))) - 48
        twice = F.when(v > 4, 2 * v - 9).otherwise(2 * v)
        return total + F.when(i % 2 == 0, twice).otherwise(v)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _found(text: Column) -> dict[str, Column]:
    """Spans by kind.  A text without the characters a kind needs is not searched for it."""
    digit, none = text.rlike("[0-9]"), _none()
    ends_label = F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "_")
    joined = F.regexp_replace(text, r"[ -](?![0-9])|(?<![0-9])[ -]", "_")
    ip = F.filter(_located(text, _IP), lambda x: x["hit"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
    card = F.filter(_located(joined, _CARD), lambda x: F.length(_digits(x["hit"])).between(13, 19) & _luhn(_digits(x["hit"])))
    phone = F.filter(_located(text, _PHONE), lambda x: F.length(_digits(x["hit"])).between(9, 15))
    secret = F.filter(_located(text, _SECRET), lambda x: x["hit"].rlike("[0-9]") & x["hit"].rlike("[A-Za-z]"))
    long_run = text.rlike(r"[A-Za-z0-9_+/-]{20}")
    return {
        "email": F.when(F.contains(text, F.lit("@")), _located(ends_label, _EMAIL)).otherwise(none),
        "ip": F.when(digit, ip).otherwise(none),
        "card": F.when(digit, card).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), phone).otherwise(none),
        "secret": F.when(digit & long_run, secret).otherwise(none),
        "national_phone": F.when(digit, _located(text, _NATIONAL)).otherwise(none),
        "spelt_email": F.when(text.rlike(r"[\[(](?:at|AT)[\])]"), _located(text, _SPELT)).otherwise(none),
    }


def _votes(kind: str, cut: Column, before: Column) -> tuple[Column, Column, Column]:
    """Regex, gazetteer and context votes of one candidate: 1, 0 or -1."""
    digits = _digits(cut)
    yes, no = F.lit(1), F.lit(-1)
    shape = {
        "email": F.when(cut.rlike(r"^[A-Za-z0-9].{0,63}@.{1,200}\.[A-Za-z]{2,}$"), yes).otherwise(no),
        "ip": F.when(cut.rlike(r"^(?:0[0-9]|.*\.0[0-9])"), no).otherwise(yes),
        "card": F.when(F.length(digits).isin(15, 16), yes).otherwise(F.lit(0)),
        "phone": F.when(cut.rlike(r"[ ().-]"), yes).otherwise(F.lit(0)),
        "secret": F.when(cut.rlike(r"^[0-9a-fA-F]{32,}$"), yes).when(cut.rlike(r"(?:[A-Za-z]+[0-9]+){3,}"), F.lit(0)).otherwise(no),
        "national_phone": F.when(cut.rlike(r"^\([0-9]{3}\) [0-9]{3}-|^[0-9]{3}-[0-9]{3}-"), yes).otherwise(F.lit(0)),
        "spelt_email": F.when(cut.rlike(r"(?i)dot|\."), yes).otherwise(no),
    }[kind]
    known = {
        "email": F.when(cut.rlike(rf"(?i)\.(?:{TOP_LEVEL})$"), yes).otherwise(F.lit(0)),
        "ip": F.when(cut.rlike(r"^(?:0|127|255)\."), no).otherwise(yes),
        "card": F.when(digits.rlike(f"^(?:{ISSUERS})"), yes).otherwise(F.lit(0)),
        "phone": F.when(digits.rlike(f"^(?:{CALLING_CODES})"), yes).otherwise(no),
        "secret": F.when(before.rlike(rf"(?i)(?:{KEY_WORDS})"), yes).otherwise(F.lit(0)),
        "national_phone": F.when(digits.rlike(r"^[01]"), no).otherwise(yes),
        "spelt_email": F.when(cut.rlike(rf"(?i)(?:{TOP_LEVEL})$"), yes).otherwise(F.lit(0)),
    }[kind]
    around = F.when(before.rlike(rf"(?iu)(?<![\p{{L}}0-9])(?:{CONTEXT[kind]})[^\p{{L}}0-9]*$"), yes)
    around = around.when(before.rlike(rf"(?iu)(?<![\p{{L}}0-9])(?:{AGAINST})[^\p{{L}}0-9]*$"), no).otherwise(F.lit(0))
    return shape, known, around


def _described(kind: str, spans: Column) -> Column:
    """Spans with their votes and features as one key: ``kind|regex|gazetteer|context|length|before|after``."""

    def one(x: Column) -> Column:
        cut, before, after = x["hit"], x["before"], x["after"]
        side = lambda c, at: F.when(c.rlike(rf"(?s){at(r'[0-9A-Za-z]')}"), "w").when(c.rlike(rf"(?s){at(r'[\s]')}"), "s").otherwise("p")
        features = (
            F.least(F.floor(F.log2(x["e"] - x["s"] + F.lit(1))), F.lit(7)).cast("string"),
            side(before, lambda c: c + "$"),
            side(after, lambda c: "^" + c),
        )
        votes = (v.cast("string") for v in _votes(kind, cut, before))
        return F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.concat_ws("|", F.lit(kind), *votes, *features).alias("code"))

    return F.transform(spans, one)


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, ``_text`` (the text, null as empty), ``_base`` and ``_loose`` candidates in the order of kinds."""
    plain = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    found = plain.withColumns({f"_{k}": spans for k, spans in _found(F.col("_text")).items()})
    seen = found.withColumn("_base", F.concat(*(_described(k, F.col(f"_{k}")) for k in BASE)))
    apart = lambda k: F.filter(f"_{k}", lambda x: ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    loose = seen.withColumn("_loose", F.concat(*(_described(k, apart(k)) for k in LOOSE)))
    return loose.drop(*(f"_{k}" for k in KINDS))


def vote_table(docs: DataFrame, text: str = "text") -> DataFrame:
    """How many candidates have each combination of votes and features."""
    both = candidates(docs.select(F.col(text).alias("text"))).select(F.explode(F.concat("_base", "_loose")).alias("c"))
    return both.groupBy(F.col("c.code").alias("code")).agg(F.count("*").alias("n"))


def estimate(counts: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """Posterior of each vote pattern by expectation-maximisation over labeler accuracies and priors, both by kind.

    Abstaining says nothing; every accuracy starts from ``ACCURACY`` right and wrong pseudo-votes, so that a labeler is
    believed to be better than chance until the others contradict it, and the two classes cannot change places.
    """
    patterns: dict[tuple[str, ...], int] = defaultdict(int)
    for code, n in counts.items():
        patterns[tuple(code.split("|")[:4])] += n
    right, prior = {}, {}
    belief: dict[tuple[str, ...], float] = {}
    for _ in range(rounds):
        for p in patterns:
            kind, *votes = p
            odds = math.log(prior.get(kind, 0.5) / (1 - prior.get(kind, 0.5)))
            for j, vote in enumerate(votes):
                accuracy = right.get((kind, j), ACCURACY[0] / sum(ACCURACY))
                odds += int(vote) * math.log(accuracy / (1 - accuracy))
            belief[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        total, hits, cast = defaultdict(float), defaultdict(float), defaultdict(float)
        yes: dict[str, float] = defaultdict(float)
        for p, n in patterns.items():
            kind, *votes = p
            total[kind] += n
            yes[kind] += n * belief[p]
            for j, vote in enumerate(votes):
                if vote != "0":
                    cast[kind, j] += n
                    hits[kind, j] += n * (belief[p] if vote == "1" else 1 - belief[p])
        prior = {k: (yes[k] + 1) / (total[k] + 2) for k in total}
        right = {k: (hits[k] + ACCURACY[0]) / (cast[k] + sum(ACCURACY)) for k in cast}
    return {"|".join(p): b for p, b in belief.items()}


def train(counts: dict[str, int]) -> dict[str, float]:
    """Probability of each combination by a naive Bayes span classifier whose soft labels are the posteriors."""
    belief = estimate(counts)
    weight: dict = defaultdict(lambda: 1.0)
    total: dict = defaultdict(lambda: 3.0)
    label = {code: belief["|".join(code.split("|")[:4])] for code in counts}
    for code, n in counts.items():
        for y, w in ((1, n * label[code]), (0, n * (1 - label[code]))):
            for place, value in enumerate(code.split("|")):
                weight[place, value, y] += w
                total[place, y] += w
    result = {}
    for code in counts:
        odds = 0.0
        for place, value in enumerate(code.split("|")):
            odds += math.log(weight[place, value, 1] / total[place, 1]) - math.log(weight[place, value, 0] / total[place, 0])
        votes_for = belief["|".join(code.split("|")[:4])]
        odds = odds / 2 + math.log(max(votes_for, 1e-9) / max(1 - votes_for, 1e-9)) / 2  # features and votes weigh alike
        result[code] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return result


def accepted(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> list[str]:
    """Combinations of loose candidates that the trained classifier takes for personal data.

    What reaches the driver is bounded by the product of kinds, votes and features, not by the rows.
    """
    counts = {r["code"]: r["n"] for r in vote_table(docs, text).collect()}
    loose = tuple(f"{k}|" for k in LOOSE)
    return sorted(code for code, p in train(counts).items() if p >= threshold and code.startswith(loose))


def find(docs: DataFrame, text: str = "text", codes: list[str] | None = None) -> DataFrame:
    """All columns plus ``_text``, ``_base`` and ``_added``: spans as arrays of (kind, s, e, code)."""
    codes = accepted(docs, text) if codes is None else codes
    found = candidates(docs, text)
    added = F.filter("_loose", lambda x: x["code"].isin(codes) if codes else F.lit(False))
    return found.withColumn("_added", added).drop("_loose")


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    one = lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts by base kind, digest of the base spans and all spans of every document."""
    found = find(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    count = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE),
        F.sha2(listed(F.col("_base")), 256).alias("base_sha256"),
        listed(F.concat("_base", "_added")).alias("spans"),
    )


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; overlapping spans become one."""
    found = find(docs, text)
    spans = F.array_sort(F.transform(F.concat("_base", "_added"), lambda x: F.struct(x["s"], x["e"], x["kind"])))
    whole = F.col("_text")

    def step(done: Column, x: Column) -> Column:
        gap = whole.substr(done["at"] + 1, F.greatest(x["s"] - done["at"], F.lit(0)))
        new = F.concat(done["out"], gap, F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        out = F.when(x["s"] >= done["at"], new).otherwise(done["out"])
        return F.struct(F.greatest(done["at"], x["e"]).alias("at"), out.alias("out"))

    last = lambda done: F.concat(done["out"], whole.substr(done["at"] + 1, F.length(whole)))
    masked = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, last)
    clean = F.when(F.size(spans) > 0, masked).otherwise(F.col(text))
    return found.withColumn(text, clean).select(docs.columns)
