import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logsift.llm import token_files, tokens
from logsift.llm.queries import QUERIES
from logsift.llm.token_files import BLOCK_IDS, image_of, read_image, read_token_files, write_token_files
from logsift.scratch import scratch_path
from tests.llm.fixtures import SMALL, docs_of, odd_texts

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ids = st.integers(0, 2**32 - 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.one_of(ids, st.integers(0, 3), st.integers(0, 5000)), max_size=200), max_size=6))
def test_image_round_trip(documents):
    arrays = [np.array(d, np.uint32) for d in documents]
    names, lengths, found = read_image(image_of([None, *range(1, len(arrays))][: len(arrays)], arrays))
    assert names == [None, *range(1, len(arrays))][: len(arrays)]
    assert lengths.tolist() == [len(d) for d in documents]
    assert found.tolist() == [i for d in documents for i in d]


@pytest.mark.parametrize("n", [BLOCK_IDS - 1, BLOCK_IDS, BLOCK_IDS + 1, 3 * BLOCK_IDS])
def test_block_edges(n):
    values = np.arange(n, dtype=np.uint32) % 50_000
    values[5] = 2**32 - 1
    assert (read_image(image_of([1], [values]))[2] == values).all()


@pytest.mark.parametrize(("path", "spaced"), [(WORD, False), (BYTE, True)])
def test_cached_chunks_equal_whole_texts(path, spaced, monkeypatch):
    monkeypatch.setattr(tokens, "KNOWN_CHUNKS", 3000)
    rnd, coder, plain = random.Random(7), tokens.TokenCoder(path, spaced), Tokenizer.from_file(path)
    coder.known.forget()
    some = ["a", "Word", " ", "  ", "\n", " \n", "\t", "\x01", "\x01\x1e\x02", "é", "é", " ", "　", "'s", "12", "!?", "Ġ", "日本", "﻿", "<|endoftext|>"]
    for _ in range(4):
        texts = ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
        found = coder.encode(pa.array(texts).slice(100))
        wanted = plain.encode_batch_fast(texts[100:], add_special_tokens=False)
        assert [f.tolist() for f in found] == [w.ids for w in wanted]
    assert [len(x) for x in coder.encode(pa.array([None, ""]))] == [0, 0]


def plain_rows(rows, path, end):
    """(doc_id, start, n_tokens, crc) in ascending doc_id order, rows without id first."""
    t, start, out = Tokenizer.from_file(path), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        found = np.array([*t.encode(text or "", add_special_tokens=False).ids, end], np.uint32)
        out.append((doc, start, len(found), zlib.crc32(found)))
        start += len(found)
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_odd_documents(spark, monkeypatch):
    folder = scratch_path(spark, "token_files")
    write_token_files(docs_of(spark, odd_texts()), folder, WORD, end_id=1)
    got = [tuple(r) for r in read_token_files(spark, folder).collect()]
    assert order(got) == order(plain_rows(odd_texts(), WORD, 1))


def test_empty_table(spark):
    folder = scratch_path(spark, "token_files")
    write_token_files(docs_of(spark, []), folder, WORD, end_id=1)
    assert read_token_files(spark, folder).count() == 0


def test_query_equals_plain(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op1_simple8b"](spark, SMALL).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(map(tuple, got.collect())) == plain_rows(rows, WORD, 1)
    assert token_files.FIELDS[0] == 60
