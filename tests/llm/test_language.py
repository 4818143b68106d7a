import base64
import math
import random
import zlib

import numpy as np
import pyarrow as pa

from logsift.llm.language import (
    BUCKETS,
    PIECE_BYTES,
    Mixture,
    held_out,
    in_known_language,
    language_counts,
    predict_languages,
    trigrams,
)
from logsift.llm.queries import QUERIES
from tests.llm.fixtures import docs_of, odd_texts

TEACH = [
    (1, "the cat and the dog were in the house with the other animals " * 3, "en"),
    (2, "der hund und die katze waren in dem haus mit den anderen tieren " * 3, "de"),
    (3, "le chien et le chat dans la maison avec les autres animaux " * 3, "fr"),
    (4, None, "en"),
    (5, "no label here", None),
]


def test_mixtures(spark):
    counts = language_counts(docs_of(spark, TEACH))
    assert sorted(counts) == ["de", "en", "fr"]
    rows = [
        (1, "The DOG with the animals"), (2, "die anderen Tiere in dem Haus"), (3, "les animaux dans la maison"),
        (4, "12 34 !!"), (5, None), (6, ""), (7, "the dog and the house with the animals. " * 4 + "der hund und die anderen tiere. " * 3),
    ]
    got = {r.doc_id: r for r in predict_languages(docs_of(spark, rows), counts).collect()}
    assert [got[d].lang_pred for d in range(1, 8)] == ["en", "de", "fr", "und", "und", "und", "en"]
    assert set(got[7].proportions) == {"en", "de"} and got[7].proportions["en"] > got[7].proportions["de"]
    assert set(got[1].proportions) == {"en"}
    assert all(0 <= r.score <= 1 for r in got.values()) and got[4].score == 0
    kept = in_known_language(docs_of(spark, rows), counts)
    assert kept.schema == docs_of(spark, rows).schema
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 7}


def test_odd_documents(spark):
    counts = language_counts(docs_of(spark, TEACH))
    got = predict_languages(docs_of(spark, odd_texts()), counts).collect()
    assert len(got) == len(odd_texts())
    nothing = predict_languages(docs_of(spark, odd_texts()), {}).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language_counts(docs_of(spark, [])) == {}
    assert predict_languages(docs_of(spark, []), counts).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = QUERIES["op8_language_mixture"](spark, folder).collect()
    assert {r.doc_id for r in got} == set(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    test = [r.lang_pred == docs[r.doc_id] for r in got if r.held_out]
    assert sum(test) > 0.98 * len(test)
    assert docs_of(spark, [(None, "x")]).where(~held_out(5)).count() == 1


def test_unlearned_texts_go(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rnd = random.Random(1)
    made = lambda letters: " ".join("".join(rnd.choices(letters, k=rnd.randint(3, 9))) for _ in range(100))
    foreign = [
        "В далёком лесу жила маленькая девочка, которая очень любила читать книги. " * 3,
        "我们今天去学校学习中文，然后在公园里散步，晚上回家吃饭。" * 4,
        "私は毎日学校へ行きます。本を読むのが好きです。" * 4,
        "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. heille on annettu järki",
        made("bcdfghjklmnpqrstvwxz"), made("abcdefghijklmnopqrstuvwxyz"),
        base64.b64encode(rnd.randbytes(600)).decode(),
    ]
    # Long texts, in one learned language and half and half.
    some = {r.lang: r.text for r in docs.where("length(text) between 1500 and 2500").orderBy("doc_id").collect()}
    known = [*some.values(), some["en"] + " " + some["de"], some["fr"] + " " + some["es"]]
    rows = list(enumerate(foreign)) + list(enumerate(known, 100))
    counts = language_counts(docs.where(~held_out(5)))
    kept = in_known_language(docs_of(spark, rows), counts, 0.3)
    assert {r.doc_id for r in kept.collect()} == {100 + i for i in range(len(known))}
    # Every text with a letter has a learned language; the background tells of the foreign ones.
    short = list(enumerate(["ok", "abc", "x", "Łódź", "²", "kaikki ihmiset syntyvät vapaina"], 200))
    found = {r.doc_id: r for r in predict_languages(docs_of(spark, rows + short), counts).collect()}
    assert all((r.lang_pred in counts) == (r.doc_id != 204) for r in found.values())
    assert all((found[d].background > 0.3) == (d < 100) for d, _ in rows)
    assert in_known_language(docs, counts, 0.3).count() == docs.count()


def test_equals_plain_mixture():
    """Proportions of every set of languages, the set by penalised likelihood, without arrays of buckets."""
    counts = {}
    for lang, text in (("en", TEACH[0][1]), ("de", TEACH[1][1]), ("fr", TEACH[2][1])):
        counts[lang] = np.bincount(trigrams(text), minlength=BUCKETS)
    chance = {n: (c + 0.5) / (c + 0.5).sum() for n, c in counts.items()}

    def fitted(grams, tables):
        share = [1 / len(tables)] * len(tables)
        for _ in range(25 if len(tables) > 1 else 0):
            sums = [0.0] * len(tables)
            for g in grams:
                part = [s * t[g] for s, t in zip(share, tables, strict=True)]
                sums = [a + p / sum(part) for a, p in zip(sums, part, strict=True)]
            new = [a / len(grams) for a in sums]
            done = max(abs(a - b) for a, b in zip(new, share, strict=True)) < 1e-4
            share = new
            if done:
                break
        return share, sum(math.log(sum(s * t[g] for s, t in zip(share, tables, strict=True))) for g in grams) / 3

    model = Mixture(counts)
    for text in ("The DOG and the cat", "x", "Der Hund the cat le chien", "die anderen Tiere, les animaux dans la maison", "日本"):
        grams = trigrams(text).tolist()
        total, price = len(grams) / 3, 0.5 * math.log(len(grams) / 3 + 2)
        names = sorted(chance)
        all_, _ = fitted(grams, [chance[n] for n in names])
        ranked = [n for _, n in sorted(zip([-s for s in all_], names, strict=True), key=lambda x: x[0])]
        best = max(range(1, 4), key=lambda n: (fitted(grams, [chance[x] for x in ranked[:n]])[1] - price * (n - 1), -n))
        share, _ = fitted(grams, [chance[x] for x in ranked[:best]])
        top = max(range(best), key=lambda k: share[k])
        lang, score, mix, background = model.predict(text)
        beside, _ = fitted(grams, [*[chance[n] for n in names], np.full(BUCKETS, 1 / BUCKETS)])
        assert lang == ranked[top] and set(mix) == set(ranked[:best])
        assert math.isclose(score, min(1.0, (share[top] * total + 1 / 3) / (total + 1)), rel_tol=1e-6)
        assert math.isclose(background, beside[-1], rel_tol=1e-6, abs_tol=1e-12)


def test_rows_go_out_in_pieces():
    class Docs:
        columns, schema = ["doc_id", "text"], None

        def mapInArrow(self, rows, schema):
            return rows

    text = "the cat and the hat " * 20_000
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10)), "text": [text] * 10})
    counts = {"en": np.bincount(trigrams(text), minlength=BUCKETS)}
    out = list(in_known_language(Docs(), counts)(iter([batch])))
    assert [i for b in out for i in b.column(0).to_pylist()] == list(range(10))
    assert max(b.num_rows for b in out) * len(text) <= PIECE_BYTES
