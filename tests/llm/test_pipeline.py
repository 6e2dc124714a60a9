import base64

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from heliograph.llm import pii, quality_rules
from tests.llm.test_decontamination import plain as plain_leaks


def alike(docs):
    """The smallest id that each document reaches over pairs whose five-word shingle sets are similar by 0.8 or more."""
    sets = {}
    for i, text in docs:
        words = text.translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in sets}


def test_pipeline_equals_brute_force(spark):
    where = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{where}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{where}/benchmark.parquet").collect()]
    judged = [(i, quality_rules.judge(t)) for i, t in docs]
    docs = [(i, j[0]) for i, j in judged if j[-1]]
    groups = alike(docs)
    docs = [(i, t) for i, t in docs if groups[i] == i]
    leaks = {i for i, _ in plain_leaks(docs, items)}
    docs = [(i, t) for i, t in docs if i not in leaks]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    spans = {r.doc_id: [(s.start, s.stop, pii.KINDS[s.kind]) for s in r.spans] for r in pii.find_spans(df).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text in docs:
        out, at = "", 0
        for start, stop, kind in sorted(spans[i]):
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, stop)
        out += text[at:]
        want.append((i, out, own.encode_ordinary(out)))
    got = corpus_pipeline.run(spark, where)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((r.doc_id, r.text, r.ids) for r in got.collect()) == sorted(want) and 0 < len(want) < len(judged)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_edges(spark, edge_rows, empty):
    docs = spark.createDataFrame([] if empty else [(i, t, "en", None, 1, "clash") for i, t in edge_rows], "doc_id long, text string, lang string, source string, n_chars long, ids string")
    docs = docs.drop("ids")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "/root/testdata/sf0.001")
        rows = out.collect()
        assert out.columns[:5] == docs.columns and not (empty and rows)
        if name == "near duplicates" and not empty:
            ids = [r.doc_id for r in rows if r.doc_id is not None]
            assert len(ids) == len(set(ids))
        if name == "byte-level BPE":
            assert [r.text for r in rows] is not None and len(rows) == docs.count()
