import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from logsift.llm.packing import Places, assembled, fullest, pack_documents, slack_plan, widened
from logsift.llm.queries import QUERIES
from tests.llm.fixtures import SMALL, docs_of, odd_texts

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def best_sum(counts, room):
    sums = {0}
    for length, copies in counts.items():
        for _ in range(copies):
            sums |= {s + length for s in sums if s + length <= room}
    return max(sums)


def test_fullest_is_best():
    rnd = random.Random(2)
    for _ in range(300):
        counts = {rnd.randint(1, 40): rnd.randint(1, 4) for _ in range(rnd.randint(1, 7))}
        room = rnd.randint(0, 100)
        chosen = fullest(counts, sorted((n for n in counts if n <= room), reverse=True), room)
        assert all(0 < k <= counts[n] for n, k in chosen.items())
        assert sum(n * k for n, k in chosen.items()) == best_sum(counts, room)


def test_plan_places_every_piece_without_gaps():
    rnd = random.Random(3)
    for _ in range(100):
        histogram = {rnd.randint(1, 64): rnd.randint(1, 50) for _ in range(rnd.randint(1, 20))}
        places = Places(slack_plan(histogram, 64))
        lengths = np.repeat(list(histogram), list(histogram.values()))
        ranks = np.concatenate([np.arange(c) for c in histogram.values()])
        bins = {}
        for s, o, n in zip(*places.of(lengths, ranks), lengths, strict=True):
            bins.setdefault(int(s), []).append((int(o), int(n)))
        assert set(bins) == set(range(places.sequences))
        for parts in bins.values():
            at = 0
            for offset, n in sorted(parts):
                assert offset == at
                at += n
            assert at <= 64


def check(rows, placed, capacity):
    """Pieces of ``placed`` against the ids of (doc_id, text) rows; returns (tokens, sequences)."""
    t = Tokenizer.from_file(BYTE)
    wanted, tokens = [], 0
    for doc, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)
        tokens += len(ids)
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            wanted.append((doc or 0, k, a, b - a, zlib.crc32(ids[a:b])))
    got = [(r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in placed]
    assert sorted(got) == sorted(wanted)
    bins = {}
    for r in placed:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return tokens, len(bins)


def test_odd_documents_and_sequences(spark):
    placed = pack_documents(docs_of(spark, odd_texts()), BYTE, 0, capacity=64, keep_ids=True)
    rows = placed.collect()
    check(odd_texts(), rows, 64)
    for r in assembled(placed).collect():
        parts = sorted((x.offset, bytes(x.ids)) for x in rows if x.sequence_id == r.sequence_id)
        assert bytes(r.ids) == b"".join(p for _, p in parts)
        assert r.length * 4 == len(r.ids)


def test_empty_table(spark):
    assert pack_documents(docs_of(spark, []), BYTE, 0).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    tokens, sequences = check(rows, QUERIES["op3_min_bin_slack"](spark, SMALL).collect(), 2048)
    assert sequences <= -(-tokens // 2048) + 1


def test_narrow_ids_become_wide():
    for rows in ([], [b""], [None, b"\x01\x00\xff\xff", b"", b"\x07\x00"]):
        for start in (0, 1):
            got = widened(pa.array(rows, pa.binary())[start:]).to_pylist()
            assert got == [None if r is None else np.frombuffer(r, "<u2").astype("<u4").tobytes() for r in rows[start:]]
