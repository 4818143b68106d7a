import hashlib
import random

import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from logsift.llm.queries import QUERIES
from logsift.llm.word_bpe import WordBpe, decoded, encoded
from tests.llm.fixtures import SMALL, docs_of, odd_texts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, OWN = Tokenizer.from_file(PATH), WordBpe(PATH)


def plain(text):
    """(ids, decoded text) of the library."""
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


def own(texts):
    ids, bounds = OWN.encode(pa.array(texts, pa.string()))
    data, ends = OWN.decode(ids, bounds)
    return [
        (ids[a:b].tolist(), data[c:d].decode())
        for a, b, c, d in zip(bounds, bounds[1:], ends, ends[1:], strict=False)
    ]


def test_ids_and_texts_of_the_library():
    rnd = random.Random(4)
    texts = [
        None, "", " \n", "It's I'LL 's's !'s don't'VE '", "<|endoftext|>", "a<|endoftext|>B<|startoftext|><|ENDOFTEXT|>",
        "ΑΣ ΟΔΟΣ Σ İ İx", "é ́ x y　z\x1c\x85", "a" * 3000, "ab" * 2001, "日本語" * 400, "12³½٣ a1b2",
        "".join(rnd.choice("abcdefgh") for _ in range(5000)),
    ]
    letters = [chr(c) for c in range(0x250)] + list("ΑΣσςßﬁ日한ि́̈​ ﻿\U0001f600①²")
    texts += ["".join(rnd.choices(letters, k=rnd.randint(1, 50))) for _ in range(2000)]
    assert own(texts) == [plain(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40), max_size=5))
def test_any_text(texts):
    assert own(texts) == [plain(t) for t in texts]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr("logsift.llm.word_bpe.KNOWN_PIECES", 50)
    texts = [" ".join(f"w{i * j}" for j in range(30)) for i in range(20)]
    for t in texts:
        assert own([t]) == [plain(t)] and len(OWN.known) <= 50


def test_odd_documents(spark):
    got = decoded(encoded(docs_of(spark, odd_texts()), PATH), PATH).collect()
    want = [(d, *plain(t)) for d, t in odd_texts()]
    key = lambda r: (r[0] or 0, r[2])
    assert sorted(((r.doc_id, r.ids, r.text) for r in got), key=key) == sorted(want, key=key)
    assert encoded(docs_of(spark, []), PATH).count() == 0
    rows = spark.createDataFrame([(1, None), (2, []), (3, [49407, 0])], "doc_id long, ids array<int>")
    assert [r.text for r in decoded(rows, PATH).orderBy("doc_id").collect()] == ["", "", "<|endoftext|> !"]


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = QUERIES["op11_merge_rounds"](spark, SMALL).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for d, t in texts.items():
        ids, text = plain(t)
        want[d] = (d, len(ids), sha(" ".join(map(str, ids))), sha(text))
    assert {r.doc_id: tuple(r) for r in got} == want and len(got) == len(texts)
