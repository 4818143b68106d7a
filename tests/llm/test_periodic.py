import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from logsift.llm import periodic
from logsift.llm.periodic import find_runs, mismatches, periodic_runs
from logsift.llm.queries import QUERIES
from tests.llm.fixtures import SMALL, docs_of, odd_texts


def plain(words):
    """All (start, length, period), by comparing every word with every later one."""
    n, out = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(6, 4 * q):
                out.setdefault((start, i + q - start), q)
            i += i == start
    return sorted((s, length, q) for (s, length), q in out.items())


def of_texts(texts):
    bounds = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
    start, length, period = find_runs(np.array([w for t in texts for w in t], np.int64), bounds)
    out = [[] for _ in texts]
    for a, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True):
        k = int(np.searchsorted(bounds, a, "right")) - 1
        out[k].append((a - int(bounds[k]), n, q))
    return out


def text(rnd):
    letters = rnd.choice([1, 2, 3, 40])
    word = lambda n: [rnd.randrange(letters) for _ in range(n)]
    out = word(rnd.randrange(60))
    for _ in range(rnd.randrange(3)):
        unit = word(rnd.randint(1, 14))
        out += unit * rnd.randint(3, 7) + unit[: rnd.randrange(len(unit))] + word(rnd.randrange(8))
    return out * rnd.choice([1, 1, 1, 5])


def test_runs_of_random_texts(monkeypatch):
    rnd = random.Random(6)
    for cells in (64, 1 << 20):
        monkeypatch.setattr(periodic, "CELLS", cells)
        for _ in range(60):
            texts = [text(rnd) for _ in range(rnd.randint(0, 5))]
            assert of_texts(texts) == [plain(t) for t in texts]


def test_sums_of_squared_differences():
    rnd = np.random.default_rng(1)
    for size in (1, 2, 8, 64):
        blocks = rnd.integers(0, periodic.PRIME, (5, size)).astype(np.uint64)
        windows = rnd.integers(0, periodic.PRIME, (5, 2 * size)).astype(np.uint64)
        windows[0, size // 2 : size // 2 + size] = blocks[0]
        got = mismatches(blocks, windows)
        want = [
            [sum((int(a) - int(b)) ** 2 for a, b in zip(row, win[s : s + size], strict=True)) % periodic.PRIME for s in range(size)]
            for row, win in zip(blocks, windows, strict=True)
        ]
        assert got.tolist() == want and got[0, size // 2] == 0


def test_fingerprints_that_fail_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic._Prints, "equal", lambda self, at, size, shift: np.ones(len(at), bool))
    words = [9, 8, *([1, 2, 3] * 4), 7, 6, *([1, 2, 3] * 5), 5]
    assert of_texts([words]) == [plain(words)] != [[]]


def test_long_texts():
    rnd = random.Random(2)
    unit = [rnd.randrange(3000) for _ in range(3000)]
    assert of_texts([[0] * 50_000, unit * 5, list(range(20_000))]) == [[(0, 50_000, 1)], [(0, 15_000, 3000)], []]


def altered(doc, words):
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def whole(doc, body):
    words = altered(doc, (body or "").encode().split())
    runs = plain(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return runs, b" ".join(w for i, w in enumerate(words) if i not in gone)


def test_odd_documents(spark, monkeypatch):
    rows = [r for r in odd_texts() if r[0] != 8] + [(k, "a b c d e f g h " * 8) for k in range(40, 70)]
    got = periodic_runs(docs_of(spark, rows), periodic.made_periodic).collect()
    key = lambda r: (r[0] or 0, r[1], r[2])
    found = [(r.doc_id, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in got]
    assert sorted(found, key=key) == sorted(((d, *whole(d, t)) for d, t in rows), key=key)
    assert periodic_runs(docs_of(spark, odd_texts())).count() == len(odd_texts())
    assert periodic_runs(docs_of(spark, [])).count() == 0


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").where("length(text) < 15000").collect()}
    got = {r.doc_id: r for r in QUERIES["op12_block_convolution"](spark, SMALL).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for d, t in texts.items():
        runs, kept = whole(d, t)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
        milli = None if best[0] is None else 1000 * best[1] // best[2]
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()
        assert tuple(got[d]) == (d, len(runs), *best, milli, sha(lines), sha(kept))
    assert sum(r.n_runs > 0 for r in got.values()) > 10
