import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from logsift.llm.chat import fold_events, parsed, read_back, render
from logsift.llm.queries import PROBE, QUERIES
from logsift.scratch import materialize
from tests.llm.fixtures import SMALL

parts = st.lists(st.sampled_from(["\\", "#", "###", "</turn>", "<", "/turn>", ":", ": ", "\n", "a", "é"]), max_size=9).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(parts, parts), max_size=5))
def test_escaping_round_trip(turns):
    from logsift.llm import chat

    role = lambda r: chat._ROLE.sub(lambda m: "\\" + m[0], r)
    text = "".join(f"### {role(r)}: {chat.escaped(t)}</turn>\n" for r, t in turns)
    assert parsed(text) == turns


def digest(rows):
    """Expected digests of (conv_id, turn, role, text) rows."""
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, *t[1:]))
        loss = "".join(t for _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def found(df):
    rows = df.collect()
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in rows}


def test_odd_conversations(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"),
            (None, 0, None, "x"), (2, 5, "system: a", "### </turn>"), (3, 0, "assistant", "long " * 50_000), (2, None, "user", "\\")]
    rows += [(4, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(3000)]
    full = [(*r, 7, "m") for r in rows]
    messages = spark.createDataFrame(full, "conv_id long, turn long, role string, text string, seq long, message string").repartition(5)
    written = materialize(render(messages), "chat")
    assert found(read_back(written)) == digest(rows)
    sizes = {r.conv_id: r.formatted_chars for r in read_back(written).collect()}
    lengths = {}
    for r in written.collect():
        lengths[r.conv_id] = lengths.get(r.conv_id, 0) + len(r.formatted)
        if r.role == "assistant":
            assert r.formatted[r.mask_stop :] == "</turn>\n"
    assert sizes == lengths


EVENTS = "conv_id long, seq long, kind string, message string, role string, text string, place long"


def test_fold(spark):
    log = [
        (1, 1, "message", "a", "user", "hi"), (1, 2, "message", "b", "assistant", "He"), (1, 3, "delta", "b", None, "llo"),
        (1, 4, "message", "c", "user", "x"), (1, 5, "edit", "a", None, "hey"), (1, 6, "regenerate", "b", None, None),
        (1, 7, "delta", "b", None, "Bye"), (1, 8, "message", "d", "user", "ok"), (1, 9, "delta", "zz", None, "lost"),
        (2, 1, "message", "a", "user", None), (2, 2, "edit", "a", None, "one"), (2, 3, "delta", "a", None, " two"),
    ]
    events = spark.createDataFrame([(*e, 1) for e in log], EVENTS).repartition(4)
    got = sorted(tuple(r) for r in fold_events(events).collect())
    assert got == [(1, 1, "user", "hey"), (1, 2, "assistant", "Bye"), (1, 8, "user", "ok"), (2, 1, "user", "one two")]


def test_empty_tables(spark):
    assert fold_events(spark.createDataFrame([], EVENTS)).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert read_back(render(none)).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)]
    assert found(QUERIES["op4_event_sourced_chat"](spark, SMALL)) == digest(rows)
