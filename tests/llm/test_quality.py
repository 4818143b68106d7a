import collections
import re

import numpy as np

from logsift.llm.quality import fit_votes, judged
from logsift.llm.queries import QUERIES
from tests.llm.fixtures import SMALL, docs_of, odd_texts, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    w, seen, copies, hit = WORD.findall(text), set(), 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), copies, len(hit), failed)


def row(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_odd_documents(spark):
    got = judged(docs_of(spark, odd_texts())).collect()
    assert sorted(map(row, got)) == sorted(plain(t) for _, t in odd_texts())
    assert all(not r.kept for r in got if r.base_failed)
    assert judged(docs_of(spark, [])).count() == 0


def test_votes_that_agree_raise_accuracy():
    votes = np.array([[1, 1, 1], [-1, -1, 1], [0, 0, 0], [0, 0, -1]])
    good = fit_votes(votes, np.array([90.0, 10.0, 5.0, 1.0]))
    assert good[0] > 0.99 and good[1] < 0.2 and good[2] == 0.5
    assert (fit_votes(votes[:, ::-1], np.array([90.0, 10.0, 5.0, 1.0])) == good).all()


def test_junk_goes_and_prose_stays(spark):
    rows = [(i, prose(i, 80, 3000)) for i in range(60)]
    rows += [(100 + i, " ".join(w + "%%%" for w in prose(i, 80).split())) for i in range(8)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in prose(i, 80).split())) for i in range(8)]
    rows += [(300 + i, " ".join(w for w in prose(i, 12).split() for _ in range(6))) for i in range(8)]
    got = {r.doc_id: r.kept for r in judged(docs_of(spark, rows)).collect()}
    assert all(got[d] == (d < 100) for d, _ in rows)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op2_weak_supervision"](spark, SMALL).collect()
    assert {r.doc_id: row(r) for r in got} == {d: plain(t) for d, t in texts.items()}


def test_verdicts_against_labels(spark):
    folder = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in QUERIES["op2_weak_supervision"](spark, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    right = [kept[r.doc_id] == (r.quality == 1) for r in labels if r.doc_id in kept]
    assert np.mean(right) > 0.95
