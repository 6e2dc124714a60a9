import zlib

from pyspark.sql import functions as F

from heliograph.llm import license_scan, quality_classifier


def test_licence_families_and_unknown(spark):
    texts = {
        1: "Some prose here.\nReleased under the MIT License.\nMore prose.", 2: "Licensed under the Apache License, Version 2.0.", 3: "This work is licensed under the GNU General Public License, version 3.",
        4: "Licensed under CC BY-NC 4.0.", 5: "He lost his driving licence after the accident.", 6: None, 7: "", 8: "No such word in this text.",
        9: "Use is subject to the Zebra Source Frobnication License agreement, clause nine.", 10: "x", 11: "x " * 50_000 + "license",
    }
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, texts[2], "x")], "doc_id long, text string, family string")
    got = {r.doc_id: r for r in license_scan.scan(df).collect()}
    assert {i: got[i].family for i in (1, 2, 3, 4, None)} == {1: "mit", 2: "apache", 3: "gpl", 4: "cc-by-nc", None: "apache"}
    assert all(got[i].confirmed for i in (1, 2, 3, 4)) and got[1].paragraph == 1
    assert not {5, 6, 7, 8} & got.keys() and got[9].family == "unknown" and not got[9].confirmed


def test_licence_scan_equals_the_classifier_outside_spark(spark, corpus):
    """Every line of every text, without the bound that spares Spark most of them; similarity and confirmation as well."""
    model, least = license_scan.trained()
    pairs = {f: {p for t in texts for p in license_scan._pairs(license_scan._words(t))} for f, texts in license_scan.TEMPLATES.items()}
    texts = [t for ts in (*license_scan.TEMPLATES.values(), license_scan.OTHERS) for t in ts]
    made = ["\n".join(["So it is, " + a, a + " " + b[: len(b) // 2], b + " " + a]) for a, b in zip(texts, texts[40:] + texts[:40])]
    corpus = corpus.select("doc_id", "text").union(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(made)], "doc_id long, text string"))
    want = {}
    for r in corpus.collect():
        for i, line in enumerate((r.text or "").split("\n")):
            words = license_scan._words(line)
            notice, k, p = model.predict(words)
            if notice:
                name, own = license_scan.FAMILIES[k], license_scan._pairs(words)
                alike = sum(x in pairs[name] for x in own) / len(own) if own else 0.0
                sure = p >= least and name != "other"
                want[r.doc_id, i] = (name if sure else "unknown", sure and alike >= license_scan.CONFIRM, p, alike)
    got = {(r.doc_id, r.paragraph): (r.family, r.confirmed, r.probability, r.similarity) for r in license_scan.scan(corpus).collect()}
    assert len(want) > 200 and got.keys() == want.keys() and all(got[k][:2] == want[k][:2] for k in want)
    assert all(abs(got[k][i] - want[k][i]) < 1e-6 for k in want for i in (2, 3))


def test_licence_texts_left_out_of_the_fit():
    """Five folds of all texts: what a model that has not seen a text makes of it, at the calibrated confidence."""
    examples, (_, least) = license_scan._examples(), license_scan.trained()
    texts = [(t, k) for k, f in enumerate(license_scan.FAMILIES) for t in license_scan.TEMPLATES.get(f, license_scan.OTHERS)]
    right = wrong = notices = taken = others = mistaken = 0
    for fold in range(5):
        model = license_scan.Regression([e for e in examples if e[2] < 0 or e[2] % 5 != fold])
        for n, (text, label) in enumerate(texts):
            if n % 5 == fold:
                notice, k, p = model.predict(license_scan._words(text))
                named = notice and p >= least
                if label == license_scan.NONE:
                    others, mistaken = others + 1, mistaken + notice
                else:
                    notices, taken, right = notices + 1, taken + notice, right + (named and k == label)
                    wrong += named and k not in (label, license_scan.OTHER)
    print("notices", notices, "taken", taken, "right", right, "wrong", wrong, "others", others, "mistaken", mistaken)
    assert taken > 0.85 * notices and right > 7 * wrong and mistaken < 0.1 * others


def test_unseen_families_are_unknown_as_often_as_stated():
    examples, (_, least) = license_scan._examples(), license_scan.trained()
    strange = []
    for kin in license_scan.KIN:
        model = license_scan.Regression([e for e in examples if license_scan.FAMILIES[e[1]] not in kin])
        strange += [p for f in kin for t in license_scan.TEMPLATES[f] for notice, _, p in [model.predict(license_scan._words(t))] if notice]
    assert 0.85 <= sum(p < least for p in strange) / len(strange) <= 0.95


def test_short_names_are_notices(spark):
    lines = ["GPLv3", "CC BY-SA 4.0", "MPL-2.0", "Distributed under the GNU GPL v3 or later.", "Licensed under the Eclipse Public License 2.0.", "Driving licence applications are accepted here", "The warranty is void if opened", "Kaffee mit Milch"]
    got = {r.doc_id: r.family for r in license_scan.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {0: "gpl", 1: "cc-by", 2: "mpl", 3: "gpl", 4: "unknown"}


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.score(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good, bad = ([r.score for r in rows if r.held_out and r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) > 0.9 * len(good) * len(bad)


def test_scores_equal_plain_votes(spark):
    """Every cosine with every labelled vector, one by one, from the fitted space."""
    import math

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    base = docs.select("doc_id", "text")
    space = quality_classifier.fit(base, labels)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, labels).collect()}
    voters = [(v.tolist(), float(y)) for v, y in zip(space.vectors, space.labels)]
    assert len(voters) > quality_classifier.NEIGHBOURS and all(abs(math.fsum(x * x for x in v) - 1) < 1e-4 for v, _ in voters)
    idf, directions = space.idf.tolist(), space.directions.T.tolist()
    for r in base.collect()[:60]:
        counts = quality_classifier.term_counts(r.text)
        terms = [(i, math.log1p(float(counts[i])) * idf[i]) for i in counts.nonzero()[0].tolist()]
        point = [math.fsum(w * d[i] for i, w in terms) for d in directions]
        size = math.sqrt(math.fsum(x * x for x in point)) or 1.0
        near = sorted(((sum(a * b for a, b in zip(point, v)) / size, y) for v, y in voters), reverse=True)[: quality_classifier.NEIGHBOURS]
        votes = [(max(c, 1e-6) ** 4, y) for c, y in near]
        assert abs(got[r.doc_id] - sum(w * y for w, y in votes) / sum(w for w, _ in votes)) < 2e-3


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))).repartition(7)
    both = [sorted((r.doc_id, r.score) for r in quality_classifier.score(docs, x).collect()) for x in (labels, other)]
    assert both[0] == both[1]


def test_edges(edge_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 0), (5, 1), (6, 1), (6, 0), (None, 1), (9, None)], "doc_id long, quality int")
    assert len(quality_classifier.score(edge_docs, labels).collect()) == edge_docs.count()
    assert {r.score for r in quality_classifier.score(edge_docs, labels.limit(0)).collect()} == {0.5}
    assert quality_classifier.score(no_docs, labels).collect() == [] and license_scan.scan(no_docs).collect() == []
    assert {r.family for r in license_scan.scan(edge_docs).collect()} <= {"unknown"}
