import hashlib
import re

import pytest

from logsift.llm import decontam
from logsift.llm.decontam import contamination, phrase_matches, positional_index
from logsift.llm.queries import QUERIES
from logsift.scratch import materialize
from tests.llm.fixtures import SMALL, docs_of, odd_texts, prose

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(rows, items, size=10):
    """(doc_id, n_words, n_hit, item ids) of every row by trying every window."""
    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(item)
    out = []
    for doc, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc or 0, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out)


def got(df):
    rows = df.collect()
    assert all(r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) for r in rows)
    return sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in rows)


def table_of_items(spark, items):
    rows = [(i, t, 1, "x") for i, t in items]
    return spark.createDataFrame(rows, "item_id long, text string, block long, place string")


@pytest.mark.parametrize("block", [8 << 20, 200])
def test_odd_documents(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "PASS_WORDS", 60)
    item = prose(50, 25)
    rows = odd_texts() + [
        (20, f"start {item} end"),
        (21, f"{item} {item} tail " * 3),
        (22, " ".join(item.split()[:9])),
        (23, "A-b; SHORT item"),
        (24, "the the the the the the the the the the the the the"),
    ]
    items = [(1, item), (2, "short ITEM"), (3, None), (4, " ... "), (None, prose(1, 12)), (10, " ".join(item.split()[3:20])), (1, item), (30, "the " * 11)]
    assert got(contamination(docs_of(spark, rows), table_of_items(spark, items))) == plain(rows, items)


def test_empty_tables(spark):
    none = table_of_items(spark, [])
    assert contamination(docs_of(spark, []), none).count() == 0
    assert got(contamination(docs_of(spark, odd_texts()), none)) == plain(odd_texts(), [])
    assert contamination(docs_of(spark, []), table_of_items(spark, [(1, "a b")])).count() == 0


def test_proximity(spark):
    rows = [(1, "x alpha q beta r gamma y"), (2, "gamma beta alpha"), (3, "alpha q q q q q beta gamma"), (4, "alpha beta"), (5, "beta gamma")]
    index = materialize(positional_index(docs_of(spark, rows, 1)), "positions")
    items = table_of_items(spark, [(9, "alpha beta gamma")])
    near = phrase_matches(index, items, slop=2).collect()
    assert sorted((r.doc_id, r.start, r.stop) for r in near) == [(1, 1, 6), (2, 0, 3)]
    assert phrase_matches(index, items).count() == 0


def test_query(spark):
    read = lambda name, key: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{name}.parquet").select(key, "text").collect()]
    wanted = [
        (d, n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0)
        for d, n, h, i in plain(read("documents", "doc_id"), read("benchmark", "item_id"))
    ]
    found = QUERIES["op10_positional_index"](spark, SMALL)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, found.select(*columns).collect())) == wanted
