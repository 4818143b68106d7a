"""What a Python worker still holds when a task of the pipeline has ended."""

import re
import subprocess
import sys
from pathlib import Path

import pyarrow as pa
import pytest

import corpus_pipeline
from logsift.llm.common import TEXT_ROWS, trimmed
from tests.llm.fixtures import SMALL, docs_of, prose

ROOT = Path(__file__).parents[2]
ONE_WORKER = """
import random, sys
from types import SimpleNamespace
import pyarrow as pa
import public_tokenizers
from logsift.llm import common, decontam, near_dedup, packing
from tests.llm.test_worker_memory import held_mb

class Docs:
    def select(self, *columns):
        return self
    def mapInArrow(self, rows, schema):
        self.rows = rows
        return self

place = SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0))
packing.TaskContext = near_dedup.TaskContext = decontam.TaskContext = place
near_dedup.text_bytes = decontam.text_bytes = lambda docs, *key: docs
docs, step = Docs(), sys.argv[1]
if step == "pack":
    packing.token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, True, 2048, True, True)
elif step == "sign":
    near_dedup.signatures(docs)
else:
    decontam.positional_index(docs)

def batches(n):
    rnd = random.Random(5)
    for k in range(n):
        texts = [" ".join(f"{rnd.randrange(200_000):x}" for _ in range(350)) for _ in range(1000)]
        kind = pa.string() if step == "pack" else pa.binary()
        yield pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([t.encode() if step != "pack" else t for t in texts], kind)], names=["doc_id", "text"])

for batch in docs.rows(batches(4)):
    pass
held = held_mb()
common.give_back()
print(held - held_mb())
"""


def held_mb():
    """MB of memory of this process that belong to no file."""
    kept = Path("/proc/self/smaps_rollup").read_text()
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", kept))) / 1024


@pytest.mark.parametrize("step", ["pack", "sign", "index"])
def test_no_free_memory_is_kept_after_a_task(step):
    run = subprocess.run([sys.executable, "-c", ONE_WORKER, step], cwd=ROOT, capture_output=True, text=True, check=True)
    assert float(run.stdout) < 8


def test_trimmed_passes_batches_on():
    batch = pa.record_batch({"x": [1, 2]})
    assert list(trimmed(lambda batches: batches)(iter([batch, batch]))) == [batch, batch]
    with pytest.raises(ValueError):
        list(trimmed(lambda batches: (int("x") for _ in batches))(iter([batch])))


def test_pack_gets_few_texts_at_once(spark, monkeypatch):
    seen, write = [], corpus_pipeline.pack_documents.__globals__["materialize"]

    def noted(df, name):
        seen.append((name, int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))))
        return write(df, name)

    monkeypatch.setitem(corpus_pipeline.pack_documents.__globals__, "materialize", noted)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = docs_of(spark, [(i, prose(i, 30)) for i in range(3)])
    assert corpus_pipeline.packed_sequences(spark, docs, SMALL).count() == 3
    assert seen == [("pieces", TEXT_ROWS)]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
