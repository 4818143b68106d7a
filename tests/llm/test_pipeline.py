import zlib

from pyspark.sql import functions as F

import corpus_pipeline
import __spark_entry__ as entry
from logsift.llm.language import Mixture, held_out, language_counts
from logsift.llm.secrets import Scanner
from tests.llm import test_decontam, test_near_dedup, test_packing
from tests.llm.fixtures import SMALL, docs_of, odd_texts, prose


def plain_stages(spark, rows, counts):
    """Documents that plain versions of the stages keep, as (doc_id, text)."""
    model = Mixture(counts)
    known = lambda p: p[0] != "und" and p[3] <= 0.3 and p[1] * (1 - p[3]) >= corpus_pipeline.LEAST_LANGUAGE
    rows = [(d, t) for d, t in rows if known(model.predict(t))]
    groups = test_near_dedup.plain(rows, 80)
    rows = [(d, t) for d, t in rows if groups[d][1] == d]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    hit = {d for d, _, n, _ in test_decontam.plain(rows, items) if n}
    scanner, out = Scanner(), []
    for d, t in rows:
        if d not in hit:
            for start, _, stop in reversed(scanner.spans(t.encode())):
                t = t[:start] + "[secret]" + t[stop:] if stop <= len(t) and "[secret]" not in t[start:stop] else t
            out.append((d, t))
    return out


def test_run_equals_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    wanted = plain_stages(spark, rows, language_counts(docs.where(~held_out(5))))
    got = corpus_pipeline.run(spark, SMALL).collect()
    test_packing.check(wanted, got, 2048)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    assert "pipeline" in entry.queries() and len(corpus_pipeline.STAGES) in (4, 5)


def test_stages_take_odd_documents(spark):
    rows = [(d, t, "en") for d, t in odd_texts()] + [(40 + i, prose(40 + i, 60), "en") for i in range(5)]
    for table in (rows, []):
        docs = docs_of(spark, table)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SMALL)
            assert out.columns == docs.columns
            assert out.count() <= len(table)
            docs = out
        placed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
        assert (placed.count() > 0) == bool(table)


def test_rows_without_id_are_judged_one_by_one(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").head()["text"]
    copy, near = prose(9, 80), prose(9, 79) + " changed"
    rows = [(None, prose(1, 60)), (None, prose(2, 60) + " " + item), (None, copy), (None, copy), (8, near), (9, copy)]
    rows += [(20, prose(3, 60)), (20, prose(4, 60)), (20, prose(3, 60)), (None, None), (None, None)]
    docs = docs_of(spark, rows).withColumn("_row", F.lit(7)).withColumn("_CHARS", F.lit("x"))
    one = corpus_pipeline.one_of_each_group(spark, docs, SMALL)
    clean = corpus_pipeline.uncontaminated(spark, one, SMALL)
    out = corpus_pipeline.without_secrets(spark, clean, SMALL)
    assert one.columns == clean.columns == out.columns == docs.columns
    left = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())
    kept = [(None, rows[0][1]), (None, rows[1][1]), (8, near), (20, rows[6][1]), (20, rows[7][1]), (None, None), (None, None)]
    assert left(one) == sorted((d or 0, t or "") for d, t in kept)
    assert left(clean) == left(out) == sorted((d or 0, t or "") for d, t in kept if t is None or item not in t)
    assert {(r._row, r._CHARS) for r in out.collect()} == {(7, "x")}
