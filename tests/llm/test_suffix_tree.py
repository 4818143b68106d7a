import collections
import itertools
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from logsift.llm import suffix_tree
from logsift.llm.language import held_out
from logsift.llm.queries import QUERIES
from logsift.llm.suffix_tree import SuffixTree, scored
from tests.llm.fixtures import SMALL, docs_of, odd_texts


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


def out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 10 == 0


def plain(rows):
    """doc_id, held_out, n_tokens, n_known, train_tokens and base score of every row."""
    counts = collections.Counter(t for d, text in rows if not out(d) for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    made = []
    for doc, text in rows:
        t = tokens(text)
        base = sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        made.append((doc or 0, out(doc), len(t), sum(counts[x] > 0 for x in t), n, base))
    return sorted(made)


def check(got, rows):
    found = sorted((r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got)
    wanted = plain(rows)
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    assert np.allclose([f[5] for f in found], [w[5] for w in wanted], rtol=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def tree_of(words):
    keys, counts = [], []
    data, place, _ = suffix_tree._symbols(words)
    for order in range(suffix_tree.DEPTH + 1):
        at = np.flatnonzero(place >= max(1, order))
        k, n = np.unique(suffix_tree._key(order, suffix_tree._contexts(data, order, at), data[at].astype(np.int64)), return_counts=True)
        keys.append(k)
        counts.append(n)
    return SuffixTree(np.concatenate(keys), np.concatenate(counts).astype(float), len(words), 1)


def test_distributions_add_up_to_one():
    words = [("".join(p)).encode() for p in itertools.product("abc", "de", "fg", "hhi")] * 3
    tree = tree_of(words)
    for lead in (b"", b"a", b"ad", b"adf", b"zz", b"cegh"):
        text = np.frombuffer(b" " + lead + b"?", np.uint8).copy()
        total = 0.0
        for symbol in range(256):
            text[-1] = symbol
            total += 10 ** tree._log10(text, np.array([len(text) - 1]), np.array([len(text) - 1]))[0]
        assert abs(total - 1) < 1e-9


def test_tree_learns_spelling():
    tree = tree_of([w.encode() for w in ("station", "nation", "ration", "motion", "notion", "potion") * 20])
    known, like, unlike = tree.words([b"station", b"lotion", b"nzqxoi"])
    assert known > like > unlike
    assert len(tree.nodes) < len(np.unique(tree.keys >> 8)) + 1


def test_odd_documents(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 5000)
    rows = odd_texts() + [(i, f"word{i % 7} and more words \x00 é {i}") for i in range(100, 160)]
    docs = docs_of(spark, rows).withColumn("held_out", held_out(10))
    got = scored(docs).collect()
    check(got, rows)


def test_no_training_and_empty_table(spark):
    docs = docs_of(spark, odd_texts()).withColumn("held_out", F.lit(True))
    got = scored(docs).collect()
    assert len(got) == len(odd_texts()) and {(r.n_known, r.train_tokens) for r in got} == {(0, 0)}
    assert scored(docs_of(spark, []).withColumn("held_out", F.lit(False))).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    check(QUERIES["op6_suffix_tree"](spark, SMALL).collect(), rows)


def plain_scores(rows):
    """Scores by a tree of dictionaries over the running symbols of the training texts."""
    depth = suffix_tree.DEPTH
    runs = [[10] * depth + list(b"".join(w + b" " for w in (t or "").encode().lower().split())) + [9] for _, t in rows]
    counts = collections.defaultdict(collections.Counter)
    for run, (doc, _) in zip(runs, rows, strict=True):
        for i in range(depth, len(run) if not out(doc) else 0):
            for order in range(depth + 1):
                counts[tuple(run[i - order : i])][run[i]] += 1

    def chance(context, symbol):
        suffix = chance(context[1:], symbol) if context else 1 / 256
        after = counts.get(context, collections.Counter())
        return (after[symbol] + suffix_tree.LEAN * suffix) / (after.total() + suffix_tree.LEAN)

    kept = {c for c in counts if len(c) <= 1}
    for context, after in counts.items():
        if context:
            gain = sum(n * math.log(n / after.total() / chance(context[1:], s)) for s, n in after.items())
            if gain >= suffix_tree.GAIN:
                kept |= {context[i:] for i in range(len(context))}

    def score(run):
        total = 0.0
        for i in range(depth, len(run)):
            context = tuple(run[i - depth : i])
            while context and context not in kept:
                context = context[1:]
            total += math.log10(chance(context, run[i]))
        return total

    return [score(run) for run in runs]


def test_scores_equal_a_tree_of_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK_BYTES", 700)
    rows = [(i, f"The mat of cat {i % 5} and\tthe hat No. {i % 9}  straße") for i in range(60)]
    rows += [(60, None), (61, " "), (62, "cat the mat of"), (63, "aaaaaaa aaaaaaaaaaa a aa"), (64, "日本語 日本語 \x00")]
    got = {r.doc_id: r.score for r in scored(docs_of(spark, rows).withColumn("held_out", held_out(10))).collect()}
    assert np.allclose([got[d] for d, _ in rows], plain_scores(rows), rtol=1e-6)


def test_order_of_words_counts(spark):
    rows = [(i, "the cat sat on the mat and then it ran out") for i in range(40)]
    rows += [(100, "the cat sat on the mat"), (101, "mat the on sat cat the")]
    docs = docs_of(spark, rows).withColumn("held_out", F.col("doc_id") >= 100)
    got = {r.doc_id: r for r in scored(docs).collect()}
    assert got[100].base_score == got[101].base_score and got[100].score > got[101].score + 1
