import hashlib
import zlib

import duckdb
from pyspark.sql import functions as F

from logsift.llm import manifest as module
from logsift.llm.manifest import manifest
from logsift.llm.queries import ORACLES, QUERIES
from tests.llm.fixtures import SMALL, docs_of, odd_texts

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def cell(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def climb(built, i, now):
    proof = []
    for hashes in built[:-1]:
        run, j = hashes[i // 8 * 8 : i // 8 * 8 + 8], i % 8
        proof += run[:j] + run[j + 1 :]
        now, i = sha(*run[:j], now, *run[j + 1 :]), i // 8
    return proof, now


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) as the operator gives them."""
    trees = {}
    for d, source, lang, n, text in rows:
        head = cell(d) + cell(source) + cell(lang) + cell(n)
        leaf = now = sha(head, cell(text))
        if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 and text is not None:
            now = sha(head, cell(text.translate(LOWER)))
        trees.setdefault(lang, []).append((d is not None, d or 0, leaf, now))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {name: levels([x[2] for x in sorted(trees[name])]) for name in names}
    upper, out = levels([built[name][-1][0] for name in names]), []
    for k, name in enumerate(names):
        for i, (known, d, leaf, now) in enumerate(sorted(trees[name])):
            low, now = climb(built[name], i, now)
            high, now = climb(upper, k, now)
            root = upper[-1][0]
            out.append((d if known else None, leaf, built[name][-1][0], root, sha(*low, *high), now, now == root))
    return out


def key(row):
    return (row[0] is None, row[0] or 0, *row[1:])


def check(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = [tuple(r) for r in manifest(docs).collect()]
    assert sorted(got, key=key) == sorted(plain(rows), key=key)
    return got


def with_langs(spark, rows):
    return docs_of(spark, rows).withColumn("n_chars", F.length("text"))


def test_odd_documents(spark):
    langs = ["en", None, "é", "E", "日", "", "en", None, "en", "fr", "en", "de", "zz"]
    rows = [(d, t, lang) for (d, t), lang in zip(odd_texts(), langs, strict=True)]
    got = check(with_langs(spark, rows))
    assert any(r[-1] for r in got)
    assert manifest(with_langs(spark, [])).count() == 0


def test_every_size_of_tree(spark, monkeypatch):
    monkeypatch.setattr(module, "SHARED", 2)
    sole = check(with_langs(spark, [(3, "One", "en")]))
    assert sole[0][1] == sole[0][2] == sole[0][3] and sole[0][4] == sha()
    check(with_langs(spark, [(i, f"Text {i}", "en") for i in range(9)]))
    check(with_langs(spark, [(i, f"Text {i}", f"l{i}") for i in range(70)]))
    rows = [(i, f"Text {i % 50}", "en") for i in range(600)] + [(i, "T", "de") for i in range(65)]
    got = check(with_langs(spark, rows + [(5, "Again", "fr")] * 9))
    assert {r[-1] for r in got} == {True, False}


def test_no_copy_of_a_node_gathers_many_runs(spark):
    docs = with_langs(spark, [(i, f"Text {i}", "en") for i in range(4000)])
    runs, nodes = module.build(docs, module.tampered())
    climbers = runs.select("p_tree", "p_level", "p_at", F.expr("pmod(xxhash64(tree, at), p_copies)").alias("copy"))
    assert climbers.groupBy(*climbers.columns).count().agg(F.max("count")).head()[0] <= 8
    last = nodes.groupBy("tree", "level", "at").agg(F.first("runs").alias("runs"), F.count("*").alias("copies"))
    assert all(r.copies == -(-r.runs // module.SHARED) for r in last.collect())
    assert spark.conf.get("spark.sql.cteRecursionRowLimit") != "-1"


def test_query_and_sql(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = sorted((tuple(r) for r in QUERIES["op13_recursive_climb"](spark, SMALL).collect()), key=key)
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert got == sorted(plain(rows), key=key)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    assert sorted(con.execute(ORACLES["op13_recursive_climb"]).fetchall(), key=key) == got
