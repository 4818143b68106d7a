import random
from collections import defaultdict

import numpy as np
import pytest

from logsift.llm import near_dedup
from logsift.llm.common import TEXT_ROWS, text_batches
from logsift.llm.near_dedup import near_duplicates, superminhash
from logsift.llm.queries import QUERIES
from tests.llm.fixtures import SMALL, docs_of, odd_texts, prose


def plain(rows, threshold=85):
    """doc_id -> (set size, smallest doc_id of the group) by comparing all pairs."""
    sets = {}
    for doc, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(set)
    for d, s in sets.items():
        for x in s:
            where[x].add(d)
    for a in sets:
        for b in set().union(*(where[x] for x in sets[a])) if sets[a] else ():
            both = len(sets[a] & sets[b])
            if 100 * both >= threshold * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for n, slots in ((1, 32), (7, 64), (3000, 64)):
        values = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
        a, b = values[:n], values[n // 2 : n + n // 2]
        owner = np.repeat([0, 1, 2], [len(a), len(b), len(a)])
        got = superminhash(np.concatenate([a, b, a[::-1]]), owner, 3, slots)
        assert (got[0] == got[2]).all() and got.max() >> 32 < slots
        if n > 1:
            real = len(set(a) & set(b)) / len(set(a) | set(b))
            assert abs((got[0] == got[1]).mean() - real) < 0.25


def edited(words, rnd, k):
    out = list(words)
    for _ in range(k):
        out[rnd.randrange(len(out))] = f"new{rnd.randrange(10**6)}"
    return " ".join(out)


@pytest.mark.parametrize("block", [256, 4])
def test_hot_group_of_near_copies(spark, monkeypatch, block):
    """Copies of one text with edits around the threshold; small blocks and hot keys in use."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "HOT_PAIRS", 5)
    rnd = random.Random(4)
    base = prose(9, 300, 5000).split()
    rows = [(i, edited(base, rnd, rnd.randint(0, 9))) for i in range(120)]
    rows += [(1000 + i, prose(100 + i, 80, 5000)) for i in range(30)]
    assert found(near_duplicates(docs_of(spark, rows, 7))) == plain(rows)


def test_chain(spark):
    words = [f"c{i}" for i in range(400)]
    rows = [(i, " ".join(words[12 * i : 12 * i + 200])) for i in range(16)]
    rows = [(15 - i, t) for i, t in rows]
    assert found(near_duplicates(docs_of(spark, rows))) == plain(rows)


def test_odd_documents(spark):
    got = near_duplicates(docs_of(spark, odd_texts())).collect()
    assert len(got) == len(odd_texts())
    rows = [r for r in odd_texts() if r[0] is not None]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == plain(rows)
    assert [r.kept for r in got if r.doc_id == 7] == [False]
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_empty_table(spark):
    assert near_duplicates(docs_of(spark, [])).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op7_superminhash"](spark, SMALL)) == plain(rows)


def test_sketches_let_every_threshold_pass(spark):
    # Hardly any pair at the threshold may be dropped before the full sets are compared.
    assert near_dedup.least_agreement(80, 160) <= 0.64 and near_dedup.least_agreement(85, 160) <= 0.70
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert found(near_duplicates(docs, 80)) == plain(rows, 80)


def test_texts_go_to_workers_in_small_batches(spark, monkeypatch):
    name, sizes = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    write = near_dedup.materialize

    def watched(df, label):
        sizes.append((label, int(spark.conf.get(name))))
        return write(df, label)

    monkeypatch.setattr(near_dedup, "materialize", watched)
    before = spark.conf.get(name)
    texts = [prose(5, 60), prose(5, 60) + " more", prose(6, 60)]
    near_duplicates(docs_of(spark, [(i, t) for i, t in enumerate(texts)])).collect()
    assert spark.conf.get(name) == before
    assert {n for label, n in sizes if label in ("signed", "links")} >= {TEXT_ROWS}
    assert all(n == TEXT_ROWS for label, n in sizes if label == "signed")
    spark.conf.set(name, "7")
    try:
        with text_batches(spark):
            assert spark.conf.get(name) == "7"
    finally:
        spark.conf.set(name, before)
