import hashlib
import random
import re

from pyspark.sql import functions as F

from heliograph.llm import pii, queries


def plain(text):
    """The base spans by Python's own matcher."""
    text = text or ""
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(s):
        d = [int(c) for c in reversed(digits(s))]
        return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0

    rules = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(s)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    )
    return [(k, m.start(), m.end()) for k, form, good in rules for m in re.finditer(form, text) if good(m[0])]


def base_of(rows):
    return [[(pii.KINDS[s.kind], s.start, s.stop) for s in r.spans if s.base] for r in rows]


def test_base_spans_equal_the_plain_matcher(spark, edge_docs, corpus):
    rng = random.Random(2)
    bits = ["a@b.c", "@", ".", "..", "a.b@c-d.e.f", "x@y", "1.2.3.4", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111", "4785380592391139", "+1 (523) 555-1055", "+", " ", "-", "  ", "--", "7", "99", "\n", "é😀", "_", "%", "(", ")", "00000000000000000"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    made += ["9" * 20_000, "1 " * 20_000, "a.b" * 20_000, "x@" + "a." * 20_000, "1." * 20_000, "+1" + " 2" * 20_000]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for df in (docs, edge_docs, corpus):
        rows = pii.find_spans(df).collect()
        for r, got in zip(rows, base_of(rows)):
            assert got == plain(r.text), repr(r.text)[:200]


def test_the_query_counts_each_kind_by_itself(spark, tmp_path):
    """All columns that the contract fixes; texts with other numbers of each kind, failing matches and extra kinds among them."""
    bits = ("a@b.co", "1.2.3.4", "4111 1111 1111 1111", "+1 (523) 555-1055", "256.1.1.1", "4111-1111-1111-1112", "+12 3", "joe [at] site [dot] org", "555-123-4567", "ssn 123-45-6789")
    rng = random.Random(3)
    texts = [None, "", "no data", *bits, *(", ".join(rng.choices(bits, k=rng.randint(2, 9))) for _ in range(200))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op4_pii(spark, str(tmp_path)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain(texts[r.doc_id])
        counts = tuple(sum(k == kind for k, _, _ in spans) for kind in ("email", "ip", "card", "phone"))
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == counts and r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), texts[r.doc_id]


def test_extra_spans_and_redaction(spark):
    texts = ['é token = "1eb9c654e721b4f812088970e66a6345cee33dd6" and mail me: joe@site.example.org now', "A plain sentence of words, no data; version 1.2.3.4 here.", None, ""]
    texts += [f'api token = "{random.Random(i).getrandbits(160):040x}" end' for i in range(30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("spans", F.lit("clash"))
    out = pii.find_spans(df, keep=("spans",)).select("doc_id", "text", "spans", "_keep0", pii.span_list(F.col("spans")).alias("list"), pii.redacted(F.col("text"), F.col("spans")).alias("clean")).orderBy("doc_id").collect()
    assert out[0].clean == 'é token = "[SECRET]" and mail me: [EMAIL] now' and out[0]["_keep0"] == "clash"
    assert out[0].list == "email:66:86,secret:11:51"
    assert out[1].list == "ip:{0}:{1}".format(texts[1].index("1.2"), texts[1].index("1.2") + 7) and out[2].list == "" and out[2].clean is None and out[3].clean == ""
    assert all("[SECRET]" in r.clean for r in out[4:])


def test_votes_alone_decide_without_spans():
    yes, no = (sum(v * 3**i for i in range(pii.LABELERS)) for v in (pii.YES, pii.NO))
    bare = pii.SpanClassifier({}, [])
    assert len(bare.by_pattern) == len(pii.KINDS) * pii.PATTERNS and bare.by_pattern[yes] == pii.LABELERS / 2 == -bare.by_pattern[no]


def test_reliabilities_equal_the_truth():
    """Labelers that are right as often as planted: the posterior must agree with Bayes' rule under the planted rates."""
    import math

    for kind, share in ((0, 0.7), (4, 0.3)):
        rng, right = random.Random(kind), (0.95, 0.9, 0.85, 0.8, 0.6)
        counts, truth = {}, {}
        for _ in range(40_000):
            real = rng.random() < share
            votes = [pii.NOTHING if rng.random() < 0.2 else pii.YES if (rng.random() < r) == real else pii.NO for r in right]
            p = sum(v * 3**i for i, v in enumerate(votes)) + kind * pii.PATTERNS
            counts[p] = counts.get(p, 0) + 1
            truth.setdefault(p, math.log(share / (1 - share)) + sum((math.log(r / (1 - r)) if v == pii.YES else -math.log(r / (1 - r))) for v, r in zip(votes, right) if v != pii.NOTHING))
        post = pii.reliabilities(counts)
        off = sum(n * abs(post[p] - 1 / (1 + math.exp(-truth[p]))) for p, n in counts.items()) / 40_000
        assert off < 0.03


def test_the_classifier_can_overrule_the_labelers():
    """One vote pattern that is right half of the time, told apart by a word beside the span that other spans teach."""
    vote = lambda *v: sum(x * 3**i for i, x in enumerate(v)) + 4 * pii.PATTERNS
    sure, never, torn = vote(1, 1, 1, 1, 2), vote(0, 0, 0, 0, 2), vote(1, 0, 2, 2, 2)
    features = lambda before: [b + 4 * pii.WIDTH for b in (*pii.BASES[:5], pii.BASES[5] + before, pii.BASES[6])]
    spans = [(sure, features(3), 500), (never, features(9), 500), (torn, features(3), 50), (torn, features(9), 50)]
    model = pii.SpanClassifier({sure: 0.99, never: 0.01, torn: 0.5}, spans)
    assert model.score(torn, features(3)) > 0.55 > 0.45 > model.score(torn, features(9))


def test_precision_and_recall_of_the_extra_kinds(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    prose = lambda: " ".join(word() for _ in range(rng.randint(3, 12)))
    alphabet = "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789"
    plant = (
        ("email", lambda: (f"write to {(v := f'{word()} [at] {word()} [dot] com')} soon", v)), ("phone", lambda: (f"call {(v := f'({rng.randint(200, 989)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)}')} now", v)),
        ("secret", lambda: (f"api_key = {(v := ''.join(rng.choice(alphabet) for _ in range(rng.choice((24, 40, 300)))))}", v)), ("national_id", lambda: (f"ssn {(v := f'{rng.randint(100, 665)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}')} of", v)),
    )
    decoys = (lambda: "see section " + "-".join(word() for _ in range(6)) + "2 below", lambda: "isbn 000-00-0000 and", lambda: f"version {word()}-{word()}-{word()}-{word()}-{word()}-{word()}-1 is out")
    docs, truth = [], set()
    for i in range(800):
        if i % 2:
            kind, make = plant[rng.randrange(4)]
            text, value = make()
            text = f"{prose()} {text} {prose()}"
            truth.add((i, kind, text.index(value), text.index(value) + len(value)))
        else:
            text = f"{prose()} {rng.choice(decoys)()} {prose()}"
        docs.append((i, text))
    found = {(r.doc_id, pii.KINDS[s.kind], s.start, s.stop) for r in pii.find_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect() for s in r.spans}
    assert len(found & truth) >= 0.95 * len(truth) and len(found & truth) >= 0.95 * len(found)


def test_many_matches_in_one_text(spark):
    text = "a@b.co x " * 20_000
    row = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert [(s.start, s.stop) for s in row.spans] == [(9 * i, 9 * i + 6) for i in range(20_000)]


def test_empty_table(no_docs):
    assert pii.find_spans(no_docs).collect() == []
