"""Language-model scores from a probabilistic suffix tree.

Tokens are the lower-cased words of a text and one end token. The tree predicts the running text
symbol by symbol: a word is its bytes and a closing blank, the end token one symbol of its own, and
DEPTH start symbols precede each text. A symbol is predicted from the longest context in the tree,
up to DEPTH symbols that reach across blanks into the words before. Contexts are counted over all
running training text. A context is retained if the distribution after it diverges enough from the
one after its suffix, or a longer context that ends in it is retained; single symbols always are.
Distributions are smoothed towards those of the suffix, down to single symbols and the uniform one.
The score of a text is the sum over its symbols, so it is the probability of the sequence of tokens.
No pair is dropped before that test, and the tree is as large as the texts make it.

Texts are read once into blocks that count their words and their windows (DEPTH symbols and the next
one). Windows are summed by Spark; those whose contexts end in the same two symbols share every
suffix of two or more symbols, so each such group builds its branch of the tree and scores its
windows, given the counts of single symbols and pairs (at most 65,536 rows). Word counts and window
scores are joined back to the blocks that asked for them. Defined results: a null text is the end
token alone; a null doc_id is training data; repeated rows are rows of their own, in training too;
an empty table gives no row; without training texts all chances are uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.llm.common import pieces
from logsift.scratch import materialize

DEPTH = 5
# Log-likelihood gain in nats that a context must bring over its suffix.
GAIN = 10.0
# Pseudo-count with which a distribution leans on that of the suffix.
LEAN = 5.0
# Blanks of texts, which no word holds: the blank between words, the end token, the start of a text.
BLANK, END, START = 32, 9, 10
BLOCK_BYTES = 12 << 20
# Bits of a key below the order of its context: up to six symbols of context, then the symbol.
_NODE, _KEY = 48, 56
# Bytes of text that are normalised together, places whose windows are sorted together, rows of a
# batch that goes out, and rows that are packed together.
PIECE_BYTES, STEP, SENT, PACKED = 1 << 21, 1 << 18, 1 << 16, 1 << 19

BLOCKS = (
    "block long, local int, word binary, window long, n long, docs array<long>, flags array<boolean>,"
    " sizes array<int>, text binary"
)
_BLOCKS = pa.schema(
    [
        ("block", pa.int64()), ("local", pa.int32()), ("word", pa.binary()), ("window", pa.int64()),
        ("n", pa.int64()), ("docs", pa.list_(pa.int64())), ("flags", pa.list_(pa.bool_())),
        ("sizes", pa.list_(pa.int32())), ("text", pa.binary()),
    ]
)


def _running(texts: pa.Array) -> pa.Array:
    """Texts as sequences of symbols: start symbols, words with a closing blank, the end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    joined = pc.ascii_trim(pc.binary_join(lists, pa.scalar(" ", pa.large_string())), " ")
    close = pc.if_else(pc.equal(pc.binary_length(joined), 0), chr(END), chr(BLANK) + chr(END)).cast(pa.large_string())
    lead, none = (pa.scalar(x, pa.large_string()) for x in (chr(START) * DEPTH, ""))
    return pc.binary_join_element_wise(lead, joined, close, none)


def _words(running: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words in order of appearance, number of each word of the texts, text it is in)."""
    lists = pc.ascii_split_whitespace(running)
    owner = np.repeat(np.arange(len(running), dtype=np.int32), np.diff(np.asarray(lists.offsets)))
    words = lists.flatten()
    del lists
    real = pc.greater(pc.binary_length(words), 0)
    words = words.filter(real)
    coded = pc.dictionary_encode(words)
    return coded.dictionary, coded.indices.to_numpy(), owner[np.asarray(real)]


def _bytes(running: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all symbols, end of each text)."""
    bounds = np.frombuffer(running.buffers()[1], np.int64)[running.offset : running.offset + len(running) + 1]
    data = running.buffers()[2]
    symbols = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return symbols[bounds[0] : bounds[-1]], bounds[1:] - bounds[0]


def _windows(data: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, windows that end there) of all symbols, STEP places at a time."""
    for start in range(DEPTH, len(data), STEP):  # every text begins with DEPTH start symbols
        part = data[start - DEPTH : start + STEP]
        n = len(part) - DEPTH
        window = np.zeros(n, np.int64)
        for place in range(DEPTH + 1):
            window <<= 8
            window |= part[place : place + n]
        real = part[DEPTH:] != START
        yield start + np.flatnonzero(real), window[real]


def _merged(windows: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of sorted runs of windows."""
    every = np.concatenate(windows)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.diff(every, prepend=-1))
    return every[first], np.add.reduceat(np.concatenate(counts)[order], first) if len(first) else every


def _counted(data: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct windows, how often each ends at a place that ``trained`` marks)."""
    found, number, size = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for at, window in _windows(data):
        both, n = np.unique(window << 1 | trained[at], return_counts=True)
        found.append(both >> 1)
        number.append(n * (both & 1))
        size += len(both)
        if size > 4 * STEP:
            found, number = ([x] for x in _merged(found, number))
            size = 0
    return _merged(found, number)


def _blocks(docs: DataFrame) -> DataFrame:
    """Per block a row for every word and for every window with its training count, and one with the texts."""

    def sent(size: int, /, **columns: pa.Array) -> Iterator[pa.RecordBatch]:
        for start in range(0, size, SENT):
            n = min(SENT, size - start)
            yield pa.RecordBatch.from_arrays(
                [columns[f.name].slice(start, n) if f.name in columns else pa.nulls(n, f.type) for f in _BLOCKS],
                schema=_BLOCKS,
            )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in pieces(batches, BLOCK_BYTES):
            running = pa.concat_arrays(
                [_running(pc.fill_null(p.column(1).cast(pa.large_string()), "")) for p in pieces([batch], PIECE_BYTES)]
            )
            held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            names, codes, owner = _words(running)
            n = len(names)
            yield from sent(
                n,
                block=pa.array(np.full(n, block)),
                local=pa.array(np.arange(n, dtype=np.int32)),
                word=names.cast(pa.large_binary()).cast(pa.binary()),
                n=pa.array(np.bincount(codes[~held[owner]], minlength=n)),
            )
            del names, codes, owner
            data, ends = _bytes(running)
            sizes = np.diff(ends, prepend=0)
            windows, counts = _counted(data, np.repeat(~held, sizes))
            n = len(windows)
            yield from sent(n, block=pa.array(np.full(n, block)), window=pa.array(windows), n=pa.array(counts))
            row = {
                "block": block, "docs": batch.column(0).to_pylist(), "flags": held.tolist(),
                "sizes": sizes.tolist(), "text": pa.compress(data, "zstd", asbytes=True),
            }
            yield pa.RecordBatch.from_pylist([row], schema=_BLOCKS)
            block += 1
            del running, data, windows, counts, row
            pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text", "held_out").mapInArrow(rows, BLOCKS)


def _symbols(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all symbols with the blank that leads each word, place in the word, number of the word)."""
    data = np.frombuffer(b"".join(b" " + w + b" " for w in words), np.uint8)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    which = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return data, place, which


def _contexts(data: np.ndarray, order: int, at: np.ndarray) -> np.ndarray:
    """The ``order`` symbols before each position as one number, the last one lowest."""
    out = np.zeros(len(at), np.int64)
    for back in range(order, 0, -1):
        out = out << 8 | data[at - back]
    return out


def _key(order: int, context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return np.int64(order) << _KEY | context << 8 | symbol


class SuffixTree:
    """Smoothed distributions of the retained contexts, as sorted tables."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, words: int, ends: int):
        order0 = [np.array([END], np.int64), np.array([1 << _KEY | BLANK << 8 | END], np.int64)]
        keys, place = np.unique(np.concatenate([keys, *order0]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([counts, [ends, ends]]))
        depth = keys >> _KEY
        nodes, node_of, = np.unique(keys >> 8, return_inverse=True)
        node_depth, context = nodes >> _NODE, nodes & ((1 << _NODE) - 1)
        total = np.zeros(len(nodes))
        kept_sum = np.bincount(node_of, weights=counts, minlength=len(nodes))
        total[node_depth == 0] = kept_sum[node_depth == 0]
        for d in range(1, DEPTH + 1):
            mine = np.flatnonzero(node_depth == d)
            place, hit = self._look(keys, (np.int64(d - 1) << _KEY) | context[mine])
            total[mine] = np.where(hit, counts[place], kept_sum[mine])
        total[nodes == (1 << _NODE | BLANK)] = words + ends  # the blank that leads a word or the end
        total = np.maximum(total, kept_sum)

        spare = (total - kept_sum + LEAN) / (total + LEAN)
        chance, suffix = np.zeros(len(keys)), np.zeros(len(keys))
        gain = np.zeros(len(nodes))
        first = depth == 0
        suffix[first] = 1 / 256
        chance[first] = counts[first] / (total[node_of[first]] + LEAN) + spare[node_of[first]] / 256
        for d in range(1, DEPTH + 1):
            mine = np.flatnonzero(depth == d)
            shorter = (np.int64(d - 1) << _KEY) | (keys[mine] & ((1 << (8 * d)) - 1))
            place, hit = self._look(keys, shorter)
            suffix[mine] = np.where(hit, chance[place], 1 / 256)
            node = node_of[mine]
            chance[mine] = counts[mine] / (total[node] + LEAN) + spare[node] * suffix[mine]
            share = np.maximum(counts[mine], 1e-300) / np.maximum(total[node], 1e-300)
            won = counts[mine] * np.log(share / suffix[mine])
            gain += np.bincount(node, weights=won, minlength=len(nodes))
        retained = (node_depth <= 1) | (gain >= GAIN)
        for d in range(DEPTH, 1, -1):  # every suffix of a retained context is retained
            mine = np.flatnonzero((node_depth == d) & retained)
            place, hit = self._look(nodes, (np.int64(d - 1) << _NODE) | (context[mine] & ((1 << (8 * (d - 1))) - 1)))
            retained[place[hit]] = True
        stay = retained[node_of]
        self.keys, self.log = keys[stay], np.log10(chance[stay])
        self.nodes, self.spare = nodes[retained], np.log10(spare[retained])

    @staticmethod
    def _look(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return place, table[place] == keys

    def _log10(self, data: np.ndarray, at: np.ndarray, room: np.ndarray) -> np.ndarray:
        """log10 chance of the symbols at ``at`` whose contexts may be ``room`` long."""
        symbol = data[at].astype(np.int64)
        out = np.full(len(at), np.log10(1 / 256))
        context = np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        for order in range(DEPTH + 1):
            if order:
                live = live[room[live] >= order]
                context[live] |= data[at[live] - order].astype(np.int64) << (8 * (order - 1))
            node, known = self._look(self.nodes, (np.int64(order) << _NODE) | context[live])
            live, node = live[known], node[known]
            place, hit = self._look(self.keys, _key(order, context[live], symbol[live]))
            out[live] = np.where(hit, self.log[place], out[live] + self.spare[node])
            if not len(live):
                break
        return out

    def words(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word."""
        if not words:
            return np.empty(0)
        data, place, which = _symbols(words)
        at = np.flatnonzero(place >= 1)
        return np.bincount(which[at], weights=self._log10(data, at, place[at]), minlength=len(words))

    def windows(self, windows: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each window after the others."""
        data = (windows[:, None] >> (8 * np.arange(DEPTH, -1, -1)) & 255).astype(np.uint8).reshape(-1)
        at = np.arange(DEPTH, len(data), DEPTH + 1)
        return self._log10(data, at, np.full(len(at), DEPTH))


def _branch(group: pa.Table, low: np.ndarray, number: np.ndarray) -> pa.Table:
    """Scores of windows whose contexts end in the same two symbols; ``low`` are pairs of symbols with their number."""
    windows, n = group.column("window").to_numpy(), group.column("n").to_numpy()
    mine = low >> 8 == windows[0] >> 8 & 255
    single = np.bincount(low & 255, weights=number, minlength=256)
    keys = [np.flatnonzero(single), np.int64(1) << _KEY | low[mine]]
    counts = [single[single > 0], number[mine]]
    for order in range(2, DEPTH + 1):
        pairs, place = np.unique(windows[n > 0] & ((1 << (8 * (order + 1))) - 1), return_inverse=True)
        keys.append(np.int64(order) << _KEY | pairs)
        counts.append(np.bincount(place, weights=n[n > 0]))
    tree = SuffixTree(np.concatenate(keys).astype(np.int64), np.concatenate(counts), 0, 0)
    return pa.table({"window": pa.array(windows), "score": pa.array(tree.windows(windows))})


def _window_scores(blocks: DataFrame) -> DataFrame:
    """(window, score): log10 chance of the last symbol of every window of any text."""
    totals = blocks.where("window is not null").groupBy("window").agg(F.sum("n").alias("n"))
    totals = materialize(totals, "windows")
    pair = F.col("window").bitwiseAND(F.lit(0xFFFF)).alias("pair")
    # One row per pair of symbols, so at most 65,536.
    pairs = totals.groupBy(pair).agg(F.sum("n").alias("n")).where("n > 0").collect()
    low, number = (np.array([r[c] for r in pairs], np.int64) for c in ("pair", "n"))
    ending = F.shiftright("window", 8).bitwiseAND(F.lit(0xFFFF)).alias("ending")
    branches = totals.groupBy(ending).applyInArrow(lambda group: _branch(group, low, number), "window long, score double")
    return materialize(branches, "scores")


PACKS = "block long, of_words boolean, first long, size int, at binary, value binary"


def _packs(rows: DataFrame, of_words: bool) -> DataFrame:
    """Rows (block, at, value, first) as arrays per block, which take a fraction of the room of rows.

    Values are counts of words or scores of windows, the latter as 32-bit numbers.
    """
    kind = np.int64 if of_words else np.float32

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        block, at, value, first = (c.to_numpy() for c in pa.Table.from_batches(held).columns)
        order = np.lexsort((at, block))
        names, starts, sizes = np.unique(block[order], return_index=True, return_counts=True)
        ats, values = np.split(at[order].astype(np.int64), starts[1:]), np.split(value[order].astype(kind), starts[1:])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(names), pa.array(np.full(len(names), of_words)),
                pa.array(np.add.reduceat(first[order].astype(np.int64), starts)), pa.array(sizes.astype(np.int32)),
                pa.array([pa.compress(np.diff(x, prepend=0), "zstd", asbytes=True) for x in ats], pa.binary()),
                pa.array([pa.compress(x, "zstd", asbytes=True) for x in values], pa.binary()),
            ],
            names=["block", "of_words", "first", "size", "at", "value"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= PACKED:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return rows.select("block", "at", "value", "first").mapInArrow(pack, PACKS)


def _unpacked(packs: pa.Table, of_words: bool) -> tuple[np.ndarray, np.ndarray]:
    """(at, value) of one block in order of ``at``."""
    kind = np.dtype(np.int64 if of_words else np.float32)
    ats, values = [np.empty(0, np.int64)], [np.empty(0, kind)]
    for row in packs.filter(pc.equal(packs.column("of_words"), of_words)).to_pylist():
        steps = np.frombuffer(pa.decompress(row["at"], 8 * row["size"], "zstd"), np.int64)
        ats.append(np.cumsum(steps))
        values.append(np.frombuffer(pa.decompress(row["value"], kind.itemsize * row["size"], "zstd"), kind))
    at, value = np.concatenate(ats), np.concatenate(values)
    order = np.argsort(at)
    return at[order], value[order].astype(float)


SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long,"
    " base_score double, score double"
)
_SCORES = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ]
)


def scored(docs: DataFrame) -> DataFrame:
    """SCORES of every row of ``docs`` (doc_id, text, held_out), learned from the rows not held out."""
    blocks = materialize(_blocks(docs), "blocks")
    same = Window.partitionBy("word")
    counted = (
        blocks.where("word is not null")
        .withColumn("value", F.sum("n").over(same))
        .withColumn("first", (F.row_number().over(same.orderBy("block")) == 1) & (F.col("value") > 0))
        .select("block", F.col("local").alias("at"), "value", "first")
    )
    words = materialize(_packs(counted, True), "words")
    held_in = F.size(F.filter("flags", lambda held: ~held))
    sums = blocks.agg(F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("n"), F.sum(held_in).alias("ends"))
    sums, ends = (lambda r: (r["n"] or 0, r["ends"] or 0))(sums.first())
    tokens, distinct = sums + ends, (words.agg(F.sum("first")).first()[0] or 0) + (1 if ends else 0)
    denominator = tokens + 0.1 * (distinct + 1)
    asked = blocks.where("window is not null").select("block", F.col("window").alias("at"))
    scores = _window_scores(blocks).select(F.col("window").alias("at"), F.col("score").alias("value"))
    windows = _packs(asked.join(scores.hint("merge"), "at").withColumn("first", F.lit(False)), False)

    def of_block(coded: pa.Table, packs: pa.Table) -> pa.Table:
        row = coded.to_pylist()[0]
        bounds = np.cumsum([0, *row["sizes"]], dtype=np.int64)
        data = np.frombuffer(pa.decompress(row["text"], int(bounds[-1]), "zstd"), np.uint8)
        n = len(bounds) - 1
        running = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        _, codes, owner = _words(running)
        lengths = np.bincount(owner, minlength=n)
        counts = np.append(_unpacked(packs, True)[1], ends)
        base = np.log10((counts + 0.1) / denominator)
        known, at_base = (np.bincount(owner, weights=x[codes], minlength=n) for x in ((counts > 0).astype(float), base))
        del codes, owner, running
        pa.default_memory_pool().release_unused()
        names, values = _unpacked(packs, False)
        score = np.zeros(n)
        for at, window in _windows(data):
            some, place = np.unique(window, return_inverse=True)
            found = values[np.searchsorted(names, some)]
            score += np.bincount(np.searchsorted(bounds[1:], at, "right"), weights=found[place], minlength=n)
        return pa.Table.from_arrays(
            [
                pa.array(row["docs"], pa.int64()),
                pa.array(row["flags"], pa.bool_()),
                pa.array(lengths + 1),
                pa.array(known.astype(np.int64) + int(ends > 0)),
                pa.array(np.full(n, tokens), pa.int64()),
                pa.array(at_base + base[-1]),
                pa.array(score),
            ],
            schema=_SCORES,
        )

    coded = blocks.where("docs is not null").select("block", "docs", "flags", "sizes", "text")
    return coded.groupBy("block").cogroup(words.union(windows).groupBy("block")).applyInArrow(of_block, SCORES)
