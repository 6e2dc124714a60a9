"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans; labelers of three sorts (regex form, gazetteer, context)
vote yes, no or nothing on each.  Counts of the vote patterns over all
documents go to the driver (a bounded table: kinds times 3 to the power of the
labelers), where expectation-maximisation estimates how reliable each labeler
is.  A logistic span classifier learns from its posteriors on a bounded sample
of spans: from the votes, and from the span itself and the words on both sides,
which the labelers don't share, so that it can overrule them.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heliograph.llm.common import bound_batches, materialize

KINDS = ("email", "ip", "card", "phone", "secret", "national_id")
LABELERS = 5
PATTERNS = 3**LABELERS
NO, YES, NOTHING = 0, 1, 2
CONTEXT = 40
#: Matches of a text that are numbered at once; more go part by part, so that no array is copied for each match.
PART = 256
#: Distinct spans (by votes and features, with their counts) that the classifier is fitted on at most.
MAX_FITTED = 20_000
#: Features of a span, by what they measure: length, distinct characters, share of digits, case, separators, word before, word after.
FEATURES = (8, 8, 6, 4, 8, 64, 64)
BASES = tuple(sum(FEATURES[:i]) for i in range(len(FEATURES)))
WIDTH = sum(FEATURES)

# Forms without loops over groups: Java's matcher would recurse on those.  The
# texts are prepared so that each form finds just what the plain one finds.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15}[0-9\x20-]*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
AT_WORDS = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._-]{0,63}\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]{1,63}\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z]{2,10}"
PLAIN_PHONE = r"(?<![0-9+)(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
SECRET = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}+"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"

#: Gazetteers: fixed values.
TOP_DOMAINS = "com|org|net|edu|gov|info|io|co|de|fr|es|uk|eu|us|it|nl|ch|at"
CALLING_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
CARD_PREFIXES = "4|5[1-5]|2[2-7]|6011|65|35|3[47]"
SECRET_NAMES = "token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|bearer"
#: Words shortly before a span that speak for its kind, and words that speak against any kind.
NEAR = ("mail|contact|write|correo|schreib", "ip|host|server|address|login|from|serveur|adresse", "card|visa|master|credit|karte|carte|tarjeta", "phone|tel|call|mobile|fax|ruf|appel", SECRET_NAMES, "ssn|social|security|national|insurance")
AGAINST = "version|isbn|issn|doi|section|chapter|figure|commit|sha|md5|checksum|build|order no|invoice no"


def _let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f refers to it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _found(text: Column, form: str) -> Column:
    """Array of (start, stop, value, near, after) of a form's matches: code points, stop exclusive, the texts around."""
    zero = "cast(array() AS array<struct<start: int, stop: int, value: string, near: string, after: string>>)"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        stop = start + F.length(x["m"])
        one = F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("value"), F.lower(F.right(x["g"], F.lit(CONTEXT))).alias("near"), x["after"].alias("after"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def part(acc: Column, chunk: Column) -> Column:
        begin = F.struct(F.element_at(acc, -1)["at"].alias("at"), F.expr(zero).alias("out"))
        return F.concat(acc, F.array(F.aggregate(chunk, begin, step)))

    def around(hits: Column, gaps: Column) -> Column:
        pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        return F.zip_with(pairs, F.slice(gaps, 2, F.size(hits)), lambda x, g: F.struct(x["m"].alias("m"), x["g"].alias("g"), F.lower(F.left(g, F.lit(CONTEXT))).alias("after")))

    def numbered(pairs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / PART).cast("int")), lambda c: F.slice(pairs, c * PART + 1, F.lit(PART)))
        done = F.aggregate(chunks, F.array(F.struct(F.lit(0).alias("at"), F.expr(zero).alias("out"))), part)
        return F.flatten(F.transform(done, lambda x: x["out"]))

    some = lambda hits: _let(_let(F.split(text, form, -1), lambda gaps: around(hits, gaps)), numbered)
    return _let(F.regexp_extract_all(text, F.lit(form), 0), lambda hits: F.when(F.size(hits) > 0, some(hits)).otherwise(F.expr(zero)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit checks the others; each second one from the right is doubled."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _octets(value: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, YES)
    return (out if no is None else out.when(no, NO)).otherwise(NOTHING)


def _pattern(kind: int, x: Column) -> Column:
    """The votes on a candidate as one number."""
    value, near, digits = x["value"], x["near"], _digits(x["value"])
    n = F.length(digits)
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    form = {
        0: _vote(value.rlike(r"^[^@]*[A-Za-z0-9]@.*\.[A-Za-z]{2,24}$"), value.rlike(r"\.[0-9]+$")),
        1: _vote(value.rlike(r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), ~_octets(value)),
        2: _vote(value.rlike(r"^(?:[0-9]{16,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})$"), value.rlike("^0")),
        3: _vote(value.rlike(r"^\+?[0-9]{0,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{2,4}[\x20.-]?[0-9]{2,4}$"), (n < 8) | (n > 15)),
        4: _vote(value.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$"), value.rlike("^[A-Za-z-]+$")),
        5: _vote(value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), value.rlike("^(?:000|666|9)|-00-|-0000$")),
    }[kind]
    check = {
        0: _vote(F.length(F.substring_index(value, "@", 1)) <= 64, F.length(value) > 254),
        1: _vote(_octets(value) & (n >= 7), ~_octets(value)),
        2: _vote(luhn(digits) & n.between(16, 19), ~luhn(digits)),
        3: _vote(n.between(10, 13), n < 8),
        4: _vote(mixed & (F.size(F.array_distinct(F.split(value, ""))) >= 10), ~mixed),
        5: F.lit(NOTHING),
    }[kind]
    gazetteer = {
        0: _vote(F.lower(value).rlike(rf"(?:\.|dot[)\]]\x20?)(?:{TOP_DOMAINS})$")),
        1: _vote(value.rlike(r"^(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."), value.rlike(r"^0+\.")),
        2: _vote(digits.rlike(f"^(?:{CARD_PREFIXES})"), digits.rlike("^(?:0|1|9)")),
        3: _vote(value.startswith("+") & digits.rlike(f"^(?:{CALLING_CODES})"), digits.rlike("^0{2,}")),
        4: _vote(near.rlike(rf"(?:{SECRET_NAMES})[^\n]{{0,16}}$")),
        5: F.lit(NOTHING),
    }[kind]
    context = _vote(near.rlike(rf"(?<![a-z])(?:{NEAR[kind]})"))
    against = F.when(near.rlike(f"(?:{AGAINST})[^a-z]*$"), NO).otherwise(NOTHING)
    total = F.lit(0)
    for i, vote in enumerate((form, check, gazetteer, context, against)):
        total = total + vote * 3**i
    return total + kind * PATTERNS


def _bits(value: Column, most: int) -> Column:
    return F.least(F.lit(most), F.floor(F.log2(value + F.lit(1))).cast("int"))


def _features(kind: int, x: Column) -> Column:
    """Numbers of what holds for a span, one for each group of FEATURES."""
    value, n = x["value"], F.length(x["value"])
    has = lambda form: F.when(value.rlike(form), 1).otherwise(0)
    word = lambda text, form: F.regexp_extract(text, form, 1)
    place = lambda w: F.when(w == "", 0).otherwise((1 + F.crc32(w.cast("binary")) % 63).cast("int"))
    all_of = (
        _bits(n, 7), _bits(F.size(F.array_distinct(F.split(value, ""))), 7), F.floor(F.length(_digits(value)) * 5 / F.greatest(n, F.lit(1))).cast("int"), has("[A-Z]") + 2 * has("[a-z]"),
        has(r"[\x20().]") + 2 * has("-") + 4 * has("[_+/=]"), place(word(x["near"], "([a-z]+)[^a-z]*$")), place(word(x["after"], "^[^a-z]*([a-z]+)")),
    )
    return F.array(*(f + (BASES[i] + kind * WIDTH) for i, f in enumerate(all_of)))


def _spans(text: Column, kind: int, form: str, base: bool, valid=None, trim: bool = False) -> Column:
    found = _found(text, form)
    if trim:
        cut = lambda x: F.rtrim(F.translate(x["value"], "-", " "))
        found = F.transform(found, lambda x: F.struct(x["start"].alias("start"), (x["start"] + F.length(cut(x))).alias("stop"), F.rtrim(x["value"]).alias("value"), x["near"].alias("near"), x["after"].alias("after")))
    if valid is not None:
        found = F.filter(found, valid)
    return F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"), F.lit(base).alias("base"), _pattern(kind, x).alias("pattern"), _features(kind, x).alias("features")))


_NONE = "cast(array() AS array<struct<kind: int, start: int, stop: int, base: boolean, pattern: int, features: array<int>>>)"


def candidates(text: Column) -> Column:
    """Array of all proposed spans of a text, the base forms' among them."""
    none = F.expr(_NONE)
    single = F.regexp_replace(text, r"[\x20-](?=[\x20-])|(?<=[\x20-])[\x20-]", "\n")  # separators next to another one join no digits
    linked = F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "_")  # such a point is in no domain; in a local part both stand
    digit = text.rlike("[0-9]")
    count = lambda x: F.length(_digits(x["value"]))
    parts = [
        F.when(F.contains(text, F.lit("@")), _spans(linked, 0, EMAIL, True)).otherwise(none),
        F.when(digit, _spans(text, 1, IP, True, lambda x: _octets(x["value"]))).otherwise(none),
        F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), _spans(single, 2, CARD, True, lambda x: count(x).between(16, 19) & luhn(_digits(x["value"])), trim=True)).otherwise(none),
        F.when(text.rlike(r"\+[0-9]"), _spans(text, 3, PHONE, True, lambda x: count(x).between(8, 15))).otherwise(none),
        F.when(F.lower(text).rlike(r"[(\[]at[)\]]"), _spans(text, 0, AT_WORDS, False)).otherwise(none),
        F.when(digit & text.rlike(PLAIN_PHONE), _spans(text, 3, PLAIN_PHONE, False)).otherwise(none),
        F.when(digit & text.rlike(SECRET), _spans(text, 4, SECRET, False, lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]"))).otherwise(none),
        F.when(digit & text.rlike(NATIONAL), _spans(text, 5, NATIONAL, False)).otherwise(none),
    ]
    return F.when(text.rlike(r"[0-9@]|[(\[](?i:at)[)\]]"), F.concat(*parts)).otherwise(none)


def _votes(pattern: int) -> list[int]:
    return [pattern // 3**i % 3 for i in range(LABELERS)]


def reliabilities(counts: dict[int, int], rounds: int = 50, prior: float = 10.0) -> dict[int, float]:
    """Posterior of each vote pattern by expectation-maximisation over the pattern counts.

    Every labeler has, for each kind, its chances to say yes, no or nothing of
    true and of false spans.  Pseudo-counts hold what a fair labeler does, so
    that few or no spans give a defined result too.
    """
    out: dict[int, float] = {}
    for kind in range(len(KINDS)):
        mine = {p: n for p, n in counts.items() if p // PATTERNS == kind}
        if not mine:
            continue
        votes = {p: _votes(p % PATTERNS) for p in mine}
        post = {p: 1 / (1 + math.exp(-1.5 * (votes[p].count(YES) - votes[p].count(NO)))) for p in mine}
        for _ in range(rounds):
            share = {True: prior * 0.5, False: prior * 0.5}
            table = {(truth, i, v): prior * {(True, YES): 0.5, (True, NO): 0.1, (False, YES): 0.1, (False, NO): 0.5}.get((truth, v), 0.4) for truth in (True, False) for i in range(LABELERS) for v in (NO, YES, NOTHING)}
            for p, n in mine.items():
                for truth, q in ((True, post[p]), (False, 1 - post[p])):
                    share[truth] += n * q
                    for i, v in enumerate(votes[p]):
                        table[truth, i, v] += n * q
            new = {}
            for p in mine:
                odds = math.log(share[True] / share[False])
                for i, v in enumerate(votes[p]):
                    odds += math.log(table[True, i, v] / share[True]) - math.log(table[False, i, v] / share[False])
                new[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            done = max(abs(new[p] - post[p]) for p in mine) < 1e-6
            post = new
            if done:
                break
        out |= post
    return out


def _of_pattern(pattern: int) -> list[int]:
    kind, votes = pattern // PATTERNS, _votes(pattern % PATTERNS)
    return [kind] + [len(KINDS) + 2 * i + v for i, v in enumerate(votes) if v != NOTHING]


class SpanClassifier:
    """Logistic regression from votes and span features to the posteriors.

    Spans weigh by log counts and by how sure their posterior is, so that those
    on which the labelers are torn learn from the others.  Without spans the
    votes alone decide, each for half a unit.
    """

    def __init__(self, posterior: dict[int, float], spans: list[tuple[int, list[int], int]], rounds: int = 300):
        votes = len(KINDS) + 2 * LABELERS
        start = np.concatenate((np.zeros(len(KINDS)), np.tile((-0.5, 0.5), LABELERS), np.zeros(len(KINDS) * WIDTH + 1)))
        spare = len(start) - 1  # for features that are absent
        deep = 1 + LABELERS
        at = np.full((len(spans), deep + len(FEATURES)), spare)
        for row, (pattern, features, _) in enumerate(spans):
            of = _of_pattern(pattern)
            at[row, : len(of)] = of
            at[row, deep:] = np.array(features) + votes
        target = np.array([posterior[p] for p, _, _ in spans])
        weigh = np.array([1 + math.log(n) for _, _, n in spans]) * np.abs(2 * target - 1)
        weigh = weigh / max(1.0, weigh.sum())
        w, square = start.copy(), np.full(len(start), 1e-8)
        for _ in range(rounds):
            w[spare] = 0
            miss = weigh * (1 / (1 + np.exp(-np.clip(w[at].sum(1), -30, 30))) - target)
            slope = np.bincount(at.ravel(), weights=np.repeat(miss, at.shape[1]), minlength=len(w)) + 1e-3 * (w - start)
            square += slope**2
            w -= 0.1 * slope / np.sqrt(square)
        w[spare] = 0
        self.by_pattern = [float(w[_of_pattern(p)].sum()) for p in range(len(KINDS) * PATTERNS)]
        self.by_feature = w[votes:spare].tolist()

    def score(self, pattern: int, features: list[int]) -> float:
        return 1 / (1 + math.exp(-(self.by_pattern[pattern] + sum(self.by_feature[f] for f in features))))

    def column(self, c: Column) -> Column:
        """The score of a candidate, over two tables that are one literal each."""
        table = lambda values: F.from_json(F.lit(json.dumps([round(v, 6) for v in values])), "array<double>")
        total = F.aggregate(c["features"], F.element_at(table(self.by_pattern), c["pattern"] + 1), lambda acc, f: acc + F.element_at(table(self.by_feature), f + 1))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def learn(found: DataFrame) -> SpanClassifier:
    """From a table with `found` (all candidates of each row): reliabilities from all spans' votes, the classifier from
    at most MAX_FITTED distinct spans, those of smallest hash."""
    every = found.select(F.explode("found").alias("c")).select("c.pattern", "c.features")
    kinds = every.groupBy("pattern", "features").agg(F.count("*").alias("n"))
    counts = {r["pattern"]: r["n"] for r in kinds.groupBy("pattern").agg(F.sum("n").alias("n")).collect()}
    some = kinds.orderBy(F.xxhash64("pattern", "features"), "pattern", "features").limit(MAX_FITTED).collect()
    spans = sorted((r["pattern"], list(r["features"]), r["n"]) for r in some)
    return SpanClassifier(reliabilities(counts), spans)


def find_spans(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, spans array<struct<kind, start, stop, base, score>> by kind, then start; then the columns of `keep`.

    Base spans always stay; a proposed span stays if the classifier gives it
    `threshold` and it overlaps no base span.  A null text counts as empty and
    has no spans; rows are judged one by one, so repeated rows and null ids
    change nothing but the counts of votes.  Candidates are searched once and
    written with their rows, for learning and for judging.
    """
    bound_batches(df.sparkSession)
    own = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)))
    rest = [f"_keep{i}" for i in range(len(keep))]
    seen = materialize(own.select("doc_id", "text", *rest, F.explode(F.array(candidates(F.coalesce("text", F.lit(""))))).alias("found")), "candidates")
    model = learn(seen)
    base = lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop"))
    seen = seen.withColumn("fixed", F.transform(F.filter("found", lambda c: c["base"]), base))
    free = lambda c: ~F.exists("fixed", lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"]))
    judged = F.transform("found", lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["stop"].alias("stop"), c["base"].alias("base"), F.round(model.column(c), 9).alias("score")))
    stays = F.filter(judged, lambda c: c["base"] | ((c["score"] >= threshold) & free(c)))
    return seen.select("doc_id", "text", F.when(F.size("found") > 0, F.array_sort(stays)).otherwise(F.expr("cast(array() AS array<struct<kind: int, start: int, stop: int, base: boolean, score: double>>)")).alias("spans"), *rest)


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with a label in place of each span; overlapping spans become one."""
    names = F.array(*map(F.lit, KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(F.element_at(names, s["kind"] + 1)), F.lit("]"))
        add = F.when(s["start"] >= acc["at"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label)).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"), F.concat(acc["out"], add).alias("out"))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(order, zero, step, finish)).otherwise(text)
