r"""Personal data and secrets by weak supervision, with DataFrame functions only.

Candidates: the base patterns (email, ip, card, phone), whose matches always stand, and wider forms that need a
verdict: spelled-out e-mail addresses, IPv6, 15-digit cards, national phone numbers, and secrets (long runs that mix
letters and digits). Labelers vote on every candidate: a strict form (regex), a gazetteer of known endings, prefixes
and ranges, cue words before it and disqualifying words before it (context), and a checksum or the variety of its
characters. A vote is for, against or abstain. The votes of all candidates of the corpus are counted per pattern, an
expectation-maximisation over the pattern counts estimates each labeler's reliability and each pattern's probability,
and a logistic classifier over votes, kind and length class is trained on these soft labels. It judges the wider
candidates. The tables of patterns are bounded by the number of labelers, kinds and length classes, not by the corpus.

Positions: the gaps between matches (split) and the matches (regexp_extract_all) come from one pattern; their
lengths add up to the spans. Patterns avoid repeated groups, which recurse in Java: a dot inside a domain and
a separator inside a number are first replaced by a control character, so that runs are plain classes. Values and
contexts are taken from matches and gaps, never from the text by position, so a text with very many matches costs
little more than its length.

Defined results: null or empty text has no spans; matches of one kind do not overlap, the leftmost wins; wider
candidates that overlap a base span are not asked, so the base span wins; very long texts are searched whole; repeated
rows repeat their result, and each counts in the estimates; other columns, of any name, are ignored; an empty table
gives an empty result. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blocklens.llm.common import materialize

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MARK = "\x01"
#: Fixed values of the labelers.
ENDINGS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "info", "eu")
CUES = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel|at",
    "ip": "ip|host|server|address|addr|adresse|from|ping|login",
    "card": "card|visa|amex|mastercard|credit|karte|carte|tarjeta|pay|payment",
    "phone": "tel|phone|call|fax|mobile|cell|ring|telefon|appelez|llame|dial",
    "secret": "token|secret|key|api_key|apikey|password|passwd|pwd|credential|auth|bearer|access_key",
}
COUNTER_CUES = "version|release|isbn|invoice|order|serial|chapter|section|page|id|no|ref"
HASH_CUES = "commit|sha|sha1|sha256|md5|hash|digest|checksum|etag|uuid|revision"
SECRET_PREFIXES = ("sk-", "sk_", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "eyJ")
CONTEXT = 24

_LOCAL = rf"A-Za-z0-9._%+{MARK}-"
_DOMAIN = "A-Za-z0-9-"
_EMAIL = rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_DOMAIN}]++{MARK}[{_DOMAIN}{MARK}]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9][0-9{MARK}]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++ ?(?:\.|[\[(]dot[\])]) ?[A-Za-z]{2,}+",
    "ip": r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9.-])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9.-])",
    "phone": r"(?<![0-9+.(-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "secret": r"(?<![A-Za-z0-9_@.+/-])[A-Za-z0-9_-]{20,}+(?![@.+/])",
}
_MAY_HAVE_WIDE = {"email": r"[\[(]at[\])]", "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:", "card": r"3[47][0-9]{2}[ -]?[0-9]{6}", "phone": r"[0-9]{3}[ .-][0-9]{4}", "secret": "[A-Za-z0-9_-]{20}"}
_ONE = "struct<start:int,end:int,value:string,before:string>"
_SPAN = f"array<{_ONE}>"
#: Matches of a stretch.
_STRETCH = 128
#: (name, column of a candidate) of every labeler; see _votes.
LABELERS = ("form", "gazetteer", "cue", "counter", "checksum")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _spans(searched: Column, pattern: str, mark: str = "") -> Column:
    """Spans of all matches of pattern in `searched`: start, end, value (MARK replaced by `mark`) and up to CONTEXT
    characters before it, back to the match before.

    A start is the sum of the gaps and matches before it: of whole stretches, and of what is before it in its own, so
    that no sum runs over the whole array for each match.
    """
    gaps, found = F.split(searched, pattern, -1), F.regexp_extract_all(searched, F.lit(pattern), F.lit(0))
    value = lambda m: F.translate(m, MARK, mark) if mark else m
    made = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m"), value(m).alias("value"), F.right(g, F.lit(CONTEXT)).alias("before")))

    def placed(pairs):
        def of_steps(steps):
            stretch = lambda c: F.slice(steps, c * _STRETCH + 1, F.lit(_STRETCH))
            sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _STRETCH).cast("int")), lambda c: _total(stretch(c)))
            return _let(sums, lambda sums: _let(F.transform(sums, lambda _, c: _total(F.slice(sums, F.lit(1), c))), lambda heads: F.transform(pairs, lambda p, i: one(steps, heads, p, i))))

        def one(steps, heads, p, i):
            c = F.floor(i / _STRETCH).cast("int")
            begin = F.get(heads, c) + _total(F.slice(steps, c * _STRETCH + 1, i % _STRETCH)) + p["g"]
            return F.struct(begin.alias("start"), (begin + p["m"]).alias("end"), p["value"].alias("value"), p["before"].alias("before"))

        return F.when(F.size(pairs) == 0, F.array().cast(_SPAN)).otherwise(_let(F.transform(pairs, lambda p: p["g"] + p["m"]), of_steps))

    return _let(made, placed)


def _apart(wide: Column, base: Column) -> Column:
    """The spans of wide that overlap none of base: base is looked at stretch by stretch, by its bounds first."""

    def bounds(base):
        def one(c):
            part = F.slice(base, c * _STRETCH + 1, F.lit(_STRETCH))
            return F.struct(F.array_min(F.transform(part, lambda b: b["start"])).alias("low"), F.array_max(F.transform(part, lambda b: b["end"])).alias("high"), part.alias("part"))

        return F.transform(F.sequence(F.lit(0), F.floor((F.size(base) - 1) / _STRETCH).cast("int")), one)

    def kept(stretches):
        meets = lambda s: F.exists(stretches, lambda t: (s["start"] < t["high"]) & (t["low"] < s["end"]) & F.exists(t["part"], lambda b: (s["start"] < b["end"]) & (b["start"] < s["end"])))
        return F.filter(wide, lambda s: ~meets(s))

    return F.when((F.size(wide) == 0) | (F.size(base) == 0), wide).otherwise(_let(bounds(base), kept))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def step(acc, i):
        x = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return acc + F.when(i % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _octets(value: Column) -> Column:
    def fits(part):
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(value, r"\."), fits)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each kind by the base patterns, checks applied."""
    none = F.array().cast(_SPAN)
    digits = lambda s: F.length(_digits(s["value"]))
    unmarked = F.translate(text, MARK, "\x02")
    dotted = F.regexp_replace(unmarked, rf"(?<=[{_DOMAIN}])\.(?=[{_DOMAIN}])", MARK)
    joined = F.regexp_replace(unmarked, r"(?<=[0-9])[ -](?=[0-9])", MARK)
    email = F.when(F.contains(text, F.lit("@")), _spans(dotted, _EMAIL, ".")).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), F.filter(_spans(text, _IP), lambda s: _octets(s["value"]))).otherwise(none)
    card = F.when(text.rlike(r"[0-9](?:[ -]?[0-9]){15}"), F.filter(_spans(joined, _CARD, "-"), lambda s: F.when(digits(s).between(16, 19), _luhn(_digits(s["value"]))).otherwise(False))).otherwise(none)
    phone = F.when(text.rlike(r"\+[0-9]"), F.filter(_spans(text, _PHONE), lambda s: digits(s).between(8, 15))).otherwise(none)
    return dict(zip(BASE, (email, ip, card, phone), strict=True))


def _wide_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast(_SPAN)
    found = {k: _spans(text, _WIDE[k]) for k in KINDS}
    found["secret"] = F.filter(found["secret"], lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    return {k: F.when(text.rlike(_MAY_HAVE_WIDE[k]), found[k]).otherwise(none) for k in KINDS}


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0)


def _votes(kind: str, s: Column) -> list[Column]:
    value, digits, before = s["value"], _digits(s["value"]), F.lower(s["before"])
    ending = F.lower(F.regexp_extract(value, "([A-Za-z]+)$", 1))
    never, always = F.lit(False), F.lit(True)
    form = {
        "email": (value.rlike(r"^[A-Za-z0-9][^@\[(]*@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+){1,5}$"), never),
        "ip": (value.rlike(r"^[1-9][0-9]{0,2}(\.[0-9]{1,3}){3}$") | F.contains(value, F.lit(":")), never),
        "card": (value.rlike(r"^[0-9]{15,16}$|^[0-9]{4}([ -][0-9]{4}){3}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$"), never),
        "phone": (value.rlike(r"^\+[0-9]{1,3} ?\(?[0-9]|^\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}$|^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), never),
        "secret": (value.rlike("^(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})$") | (value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("^[^_-]*[0-9][^_-]*$")), value.rlike("--|__|^[0-9-]+[A-Za-z]?$")),
    }[kind]
    gazetteer = {
        "email": (ending.isin(*ENDINGS), F.length(ending) < 2),
        "ip": (value.rlike(r"^(10|127|172|192|[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\.") | value.rlike("^(2[0-9a-f]{3}|fe80):"), value.rlike(r"^(0|22[4-9]|2[345][0-9])\.")),
        "card": (digits.rlike("^(4|5[1-5]|2[2-7]|6011|65|3[47])"), digits.rlike("^(0|9)")),
        "phone": (digits.rlike("^1?[2-9]") | F.startswith(value, F.lit("+")), digits.rlike("^0{2}|^1?[01]")),
        "secret": (F.regexp_like(value, F.lit(f"^({'|'.join(SECRET_PREFIXES)})")), never),
    }[kind]
    same = digits.rlike(r"^([0-9])\1*$")
    variety = F.size(F.array_distinct(F.split(F.substring(value, 1, 128), "")))
    checksum = {
        "email": (always & (F.length(value) >= 6), F.length(value) < 6),
        "ip": (F.when(F.contains(value, F.lit(":")), always).otherwise(_octets(value)), never),
        "card": (_luhn(digits) & ~same, ~_luhn(digits) | same),
        "phone": (F.length(digits).between(10, 13) & ~same, same),
        "secret": (variety >= 10, variety < 8),
    }[kind]
    counter = f"{COUNTER_CUES}|{HASH_CUES}" if kind == "secret" else COUNTER_CUES
    return [_vote(*form), _vote(*gazetteer), _vote(before.rlike(rf"\b({CUES[kind]})\b"), never), _vote(never, before.rlike(rf"\b({counter})\W*$")), _vote(*checksum)]


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, c: array of (kind, start, end, base, votes, size) of every candidate of the text."""
    text = F.coalesce("text", F.lit(""))
    # spans first, votes on spans only: texts are searched once
    base, wide = base_spans(F.col("t")), _wide_spans(F.col("t"))
    found = docs.select("doc_id", text.alias("t")).select("doc_id", *[v.alias(f"b{i}") for i, v in enumerate(base.values())], *[v.alias(f"w{i}") for i, v in enumerate(wide.values())])
    every_base = F.concat(*[F.col(f"b{i}") for i in range(len(BASE))])

    def judged(i: int, kind: str, spans: Column, is_base: bool) -> Column:
        def one(s):
            size = F.least(F.floor(F.length(s["value"]) / 8), F.lit(4)).cast("int")
            return F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(is_base).alias("base"), F.array(*_votes(kind, s)).alias("votes"), size.alias("size"))

        return F.transform(spans, one)

    parts = [judged(i, k, F.col(f"b{i}"), True) for i, k in enumerate(BASE)] + [judged(i, k, _apart(F.col(f"w{i}"), every_base), False) for i, k in enumerate(KINDS)]
    return found.select("doc_id", F.concat(*parts).alias("c"))


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """EM over vote patterns: (probability of each pattern, P(vote | true), P(vote | false) per labeler)."""
    n = votes.shape[1]
    share = 1 / (1 + np.exp(-votes.sum(axis=1, dtype=float)))
    for _ in range(rounds):
        tables = []
        for weight in (counts * share, counts * (1 - share)):
            t = np.array([[weight[votes[:, j] == v].sum() + 1.0 for v in (-1, 0, 1)] for j in range(n)])
            tables.append(t / t.sum(axis=1, keepdims=True))
        prior = ((counts * share).sum() + 1) / (counts.sum() + 2)
        score = np.full(len(votes), math.log(prior / (1 - prior)))
        for j in range(n):
            score += np.log(tables[0][j][votes[:, j] + 1] / tables[1][j][votes[:, j] + 1])
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - share).max() < 1e-9:
            break
        share = new
    return share, tables[0], tables[1]


def _features(votes: np.ndarray, kinds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    parts = [votes == 1, votes == -1, kinds[:, None] == np.arange(len(KINDS)), sizes[:, None] == np.arange(5), np.ones((len(kinds), 1), bool)]
    return np.concatenate(parts, axis=1).astype(float)


def train(patterns: list) -> np.ndarray:
    """Weights of the span classifier from rows (kind, votes, size, count) of all candidates."""
    width = 2 * len(LABELERS) + len(KINDS) + 5 + 1
    if not patterns:
        return np.zeros(width)
    votes, counts = np.array([r["votes"] for r in patterns]), np.array([r["count"] for r in patterns], float)
    kinds, sizes = np.array([r["kind"] for r in patterns]), np.array([r["size"] for r in patterns])
    soft, _, _ = reliabilities(votes, counts)
    x, w = _features(votes, kinds, sizes), np.zeros(width)
    mass = counts / counts.sum()
    for _ in range(100):  # Newton steps with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (mass * (p - soft)) + 1e-3 * w
        hessian = (x * (mass * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(width)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _accepted(c: Column, weights: np.ndarray) -> Column:
    n = len(LABELERS)
    score = F.lit(float(weights[-1]))
    for j in range(n):
        vote = F.get(c["votes"], F.lit(j))
        score = score + F.when(vote == 1, float(weights[j])).when(vote == -1, float(weights[n + j])).otherwise(0.0)
    for i in range(len(KINDS)):
        score = score + F.when(c["kind"] == i, float(weights[2 * n + i])).otherwise(0.0)
    for i in range(5):
        score = score + F.when(c["size"] == i, float(weights[2 * n + len(KINDS) + i])).otherwise(0.0)
    return score > 0


def _listed(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", F.get(kind, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans for every row of docs.

    n_secret and n_spans count what stands in spans: secrets, and spans of all kinds.
    """
    found = materialize(candidates(docs))
    patterns = found.select(F.explode("c").alias("c")).groupBy("c.kind", "c.votes", "c.size").count().collect()  # bounded: 5 x 3^5 x 5 at most
    weights = train(patterns)
    base = F.filter("c", lambda c: c["base"])
    kept = F.filter("c", lambda c: c["base"] | _accepted(c, weights))
    kinds = lambda spans: F.transform(spans, lambda c: c["kind"])
    of_kind = lambda spans, i: (F.size(spans) - F.size(F.array_remove(kinds(spans), i))).cast("long")
    counts = [of_kind(base, i).alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(kept).alias("spans"), of_kind(kept, len(BASE)).alias("n_secret"), F.size(kept).cast("long").alias("n_spans"))
