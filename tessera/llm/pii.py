"""Personal data by weak supervision, with built-in expressions only.

Patterns propose candidate spans: the four base kinds (whose valid matches always stay) and wider ones (written-out email
addresses, national phone numbers, secrets after a keyword, cards of 13 to 15 digits). Labelers vote on
each candidate (-1, 0, 1): the strict pattern, gazetteers (mail endings, country calling codes, card issuers, address blocks,
key prefixes), cue words before it, its edges, its length and its shape.
Expectation-maximisation over the counts of vote patterns (a table whose size is fixed by the number of labelers) estimates
the labelers' reliabilities; its posteriors train a logistic span classifier on votes, length and digit share, which decides
about the candidates that are not base spans.

A match is found in place: the pattern's replacement sets marks around it, and splitting at the marks gives the lengths of
all pieces and so the offsets in code points. Nothing is shuffled but the vote counts, and a document is one row throughout.

Defined cases: null texts are empty; each row is treated on its own, so repeated rows repeat their result; texts without a
span have zero counts, the digest of the empty string and an empty span list; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
MARK, OTHER = "\x01", "\x02"

# Possessive forms of the base patterns: they match the same spans without recursion or repeated scans of long runs.
LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WIDE_EMAIL = r"(?i)\b[a-z0-9._%+-]{1,64}\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]{1,63}(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z0-9-]{1,63})++"
WIDE_PHONE = r"(?<![0-9+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SECRET = r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\x20?[=:]\x20?[\"']?[A-Za-z0-9+/_.-]{6,}+"
PATTERNS = ((0, EMAIL, "@"), (1, IP, "."), (2, CARD, None), (3, PHONE, "+"), (0, WIDE_EMAIL, "at"), (3, WIDE_PHONE, None), (4, SECRET, None))
BASE = 4  # the first patterns are the base kinds

# Public lists of mail endings, country calling codes, issuer ranges, key prefixes.
ENDINGS = ("com", "org", "net", "edu", "gov", "mil", "int", "io", "info", "biz", "dev", "app", "eu", "de", "fr", "es", "it", "nl", "be", "at", "ch", "pt", "pl", "cz", "dk", "se", "no", "fi", "ie", "gr", "ru", "ua", "tr", "uk", "us", "ca", "mx", "br", "ar", "cl", "co", "au", "nz", "jp", "cn", "kr", "in", "za")
CALLING = r"^(?:1|7|2[07]|2[1-69][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[58][0-9]|9[0-58]|9[679][0-9])"
AREA = r"^[2-9](?!11)[0-9]{2}"
ISSUERS = r"^(?:4|5[0-8]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|220[0-4]|3[0145678]|6[0-9]|81|9792)"
BLOCKS = r"^0*(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\."
KEYS = r"[=:]\x20?[\"']?(?:AKIA|ASIA|gh[pousr]_|xox[abp]-|sk-|pk_|eyJ|[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})"
CUES = r"(?i)(?:e-?mail|mailto|contact|phone|tel|call|fax|mobile|host|addr|address|ip|from|card|visa|payment|account|login|user|password|passwd|token|secret|key)\b[^\p{L}\n]{0,6}$"
VOTES = ("strict", "gazetteer", "cue", "edge", "length", "shape")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(pattern: int, m: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    n = F.length(_digits(m))
    if pattern == 1:
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike(r"^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if pattern == 2:
        return F.when(n.between(16, 19), F.call_function("luhn_check", _digits(m))).otherwise(F.lit(False))
    if pattern == 3:
        return n.between(8, 15)
    return F.lit(pattern == 0)


def _candidates(pattern: int, kind: int, parts: Column, ends: Column) -> Column:
    """Structs of the pattern's matches; ends: cumulative lengths of the parts."""

    def one(i: Column) -> Column:
        m, before, after = F.get(parts, i), F.get(parts, i - 1), F.get(parts, i + 1)
        start, end = F.get(ends, i - 1), F.get(ends, i)
        valid = _valid(pattern, m)
        n_digits, size = F.length(_digits(m)), F.length(m)
        strict = F.when(valid, 1).otherwise(-1) if pattern < BASE else F.lit(0)
        sure = lambda test: F.when(test, 1).otherwise(-1)
        if kind == 0:
            gazetteer = sure(F.lower(F.regexp_extract(m, r"([A-Za-z]+)\W*$", 1)).isin(*ENDINGS))
            length, shape = sure(size.between(6, 254)), sure(~m.rlike(r"^[.+%-]|\.@|\.\."))
        elif kind == 1:
            gazetteer, length, shape = sure(m.rlike(BLOCKS)), F.lit(0), sure(~m.rlike(r"^0[0-9]|\.0[0-9]"))
        elif kind == 2:
            gazetteer, length, shape = sure(_digits(m).rlike(ISSUERS)), sure(n_digits.between(15, 16)), sure(m.rlike(r"^(?:[0-9]+|[0-9]{4}(?:[\x20-][0-9]{4})+)$"))
        elif kind == 3:
            gazetteer = sure(_digits(m).rlike(CALLING if pattern < BASE else AREA))
            length, shape = sure(n_digits.between(10, 13)), sure(m.rlike(r"^[^()]*(?:\([0-9]+\)[^()]*)?$"))
        else:
            value = F.regexp_extract(m, r"[=:]\x20?[\"']?(.*)$", 1)
            gazetteer, length, shape = F.when(m.rlike(KEYS), 1).otherwise(0), sure(F.length(value) >= 12), sure(value.rlike("[0-9]"))
        cue = F.when(F.right(before, F.lit(40)).rlike(CUES), 1).otherwise(0)
        edge = F.when(F.right(before, F.lit(1)).rlike(r"[\p{L}\p{N}]") | F.left(after, F.lit(1)).rlike(r"[\p{L}\p{N}]"), -1).otherwise(1)
        return F.struct(
            F.lit(kind).alias("kind"), start.cast("long").alias("start"), end.cast("long").alias("end"), valid.alias("base"),
            strict.alias("strict"), gazetteer.alias("gazetteer"), cue.alias("cue"), edge.alias("edge"), length.alias("length"), shape.alias("shape"),
            F.least(F.lit(4), (size / 8).cast("int")).alias("size"), F.least(F.lit(4), (5 * n_digits / size).cast("int")).alias("digits"), n_digits.alias("n_digits"),
            F.call_function("luhn_check", _digits(m)).alias("luhn"),
        )

    matches = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    kept = F.transform(matches, one)
    if pattern == 2:  # of digit runs, those of a card's length and checksum only
        return F.filter(kept, lambda c: c["n_digits"].between(13, 19) & c["luhn"])
    return kept


def _ends(parts: str, block: int = 128) -> Column:
    """Cumulative lengths of the parts, summed by block so that the work stays nearly linear in their number."""
    lens = F.transform(parts, F.length)
    starts = F.sequence(F.lit(1), F.size(parts), F.lit(block))
    sums = F.transform(starts, lambda s: F.aggregate(F.slice(lens, s, block), F.lit(0), lambda a, x: a + x))
    before = F.slice(F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), F.lit(1), F.size(sums))
    run = lambda s, b: F.slice(F.aggregate(F.slice(lens, s, block), F.array(b), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), 2, block)
    return F.when(F.size(parts) > 1, F.flatten(F.zip_with(starts, before, run)))


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and cands, all candidate spans of the row's text."""
    text = F.translate(F.coalesce("text", F.lit("")), MARK, OTHER)
    df = docs.select("doc_id", text.alias("t"))
    marked = []
    for n, (_, pattern, needed) in enumerate(PATTERNS):
        parts = F.split(F.regexp_replace("t", pattern, f"{MARK}$0{MARK}"), MARK, -1)
        apt = F.contains(F.lower("t"), F.lit(needed)) if needed else F.col("t").rlike("[0-9]")
        marked.append(F.when(apt, parts).otherwise(F.array(F.lit(""))).alias(f"p{n}"))
    df = df.select("doc_id", *marked)
    df = df.select("*", *(_ends(f"p{n}").alias(f"e{n}") for n in range(len(PATTERNS))))
    return df.select("doc_id", F.concat(*(_candidates(n, kind, F.col(f"p{n}"), F.col(f"e{n}")) for n, (kind, _, _) in enumerate(PATTERNS))).alias("cands"))


def reliabilities(counts: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[list[tuple[float, float]], float, dict[tuple[int, ...], float]]:
    """EM over vote patterns: per labeler P(vote agrees | span) and P(vote agrees | no span), the prior, the posteriors."""
    n = len(VOTES)
    right = [(0.8, 0.8)] * n
    prior, posterior = 0.5, {}
    for _ in range(rounds):
        for votes, _ in counts:
            yes, no = math.log(prior), math.log(1 - prior)
            for v, (a, b) in zip(votes, right, strict=True):
                if v:
                    yes += math.log(a if v > 0 else 1 - a)
                    no += math.log(1 - b if v > 0 else b)
            posterior[votes] = 1 / (1 + math.exp(max(-50.0, min(50.0, no - yes))))
        total = sum(c for _, c in counts)
        prior = min(0.99, max(0.01, sum(c * posterior[v] for v, c in counts) / max(total, 1)))
        fresh = []
        for k in range(n):
            cast = [(v, c) for v, c in counts if v[k]]
            pos = sum(c * posterior[v] for v, c in cast)
            neg = sum(c * (1 - posterior[v]) for v, c in cast)
            a = (sum(c * posterior[v] for v, c in cast if v[k] > 0) + 4) / (pos + 5)
            b = (sum(c * (1 - posterior[v]) for v, c in cast if v[k] < 0) + 4) / (neg + 5)
            fresh.append((min(0.99, max(0.5, a)), min(0.99, max(0.5, b))))
        right = fresh
    return right, prior, posterior


def train_classifier(rows: list[tuple[tuple[int, ...], int, float]], rounds: int = 400) -> list[float]:
    """Logistic regression on (features, count, target); the last weight is the intercept."""
    if not rows:
        return []
    width = len(rows[0][0])
    weight, total = [0.0] * (width + 1), sum(c for _, c, _ in rows)
    for _ in range(rounds):
        grad = [1e-3 * w for w in weight]
        for x, c, y in rows:
            z = weight[-1] + sum(w * v for w, v in zip(weight, x, strict=False))
            miss = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * c / total
            for k, v in enumerate(x):
                grad[k] += miss * v
            grad[-1] += miss
        weight = [w - 0.5 * g for w, g in zip(weight, grad, strict=True)]
    return weight


FEATURES = (*VOTES, *(f"kind{k}" for k in range(len(KINDS))), "size", "digits")


def _features(votes: tuple[int, ...], kind: int, size: int, digits: int) -> tuple[float, ...]:
    return (*votes, *(float(kind == k) for k in range(len(KINDS))), size / 4, digits / 4)


def fit(cands: DataFrame) -> list[float]:
    """Weights of the span classifier, from the counts of (votes, kind, size, digits): at most 729 * 5 * 5 * 5 rows."""
    counts = cands.select(F.explode("cands").alias("c")).groupBy(*(F.col(f"c.{v}").alias(v) for v in (*VOTES, "kind", "size", "digits"))).agg(F.count(F.lit(1)).alias("n")).collect()
    by_votes: dict[tuple[int, ...], int] = {}
    for r in counts:
        votes = tuple(r[v] for v in VOTES)
        by_votes[votes] = by_votes.get(votes, 0) + r["n"]
    _, _, posterior = reliabilities(sorted(by_votes.items()))
    rows = sorted((_features(tuple(r[v] for v in VOTES), r["kind"], r["size"], r["digits"]), r["n"], posterior[tuple(r[v] for v in VOTES)]) for r in counts)
    return train_classifier(rows)


def _accepted(c: Column, weights: list[float]) -> Column:
    if not weights:
        return F.lit(False)
    x = [*(c[v].cast("double") for v in VOTES), *((c["kind"] == k).cast("double") for k in range(len(KINDS))), c["size"] / 4, c["digits"] / 4]
    z = F.lit(weights[-1])
    for w, v in zip(weights, x, strict=False):
        z = z + F.lit(w) * v
    return z >= 0


def spans(cands: DataFrame, weights: list[float]) -> DataFrame:
    """doc_id, base and spans: sorted arrays of (kind, start, end); a base span wins over what overlaps it."""
    base = F.filter("cands", lambda c: c["base"])
    more = F.filter("cands", lambda c: ~c["base"] & _accepted(c, weights))
    plain = lambda a: F.array_sort(F.transform(a, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    df = cands.select("doc_id", plain(base).alias("base"), plain(more).alias("more"))
    free = F.filter("more", lambda m: ~F.exists("base", lambda b: (m["start"] < b["end"]) & (b["start"] < m["end"])))
    df = df.select("doc_id", "base", F.array_sort(F.concat("base", free)).alias("found"))
    return df.select("doc_id", "base", F.filter("found", lambda s, i: (i == 0) | (s != F.get("found", i - 1))).alias("spans"))


def written(spans_column: str) -> Column:
    """kind:start:end of all spans, joined by commas."""
    name = lambda s: F.element_at(F.array(*(F.lit(k) for k in KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The texts of docs (unique doc_id) with each span replaced by its kind in brackets."""
    kinds = F.array(*(F.lit(f"[{k}]") for k in KINDS))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    step = lambda acc, s: F.when(s["start"] >= acc["at"], F.struct(F.concat(acc["out"], F.substring(acc["t"], (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.element_at(kinds, s["kind"] + 1)).alias("out"), s["end"].alias("at"), acc["t"].alias("t"))).otherwise(acc)
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"), F.coalesce("text", F.lit("")).alias("t"))
    done = F.aggregate("ordered", start, step, lambda acc: F.concat(acc["out"], F.substring(acc["t"], (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    joined = docs.select("doc_id", "text").join(found.select("doc_id", ordered.alias("ordered")), "doc_id")
    return joined.select("doc_id", done.alias("text"))
