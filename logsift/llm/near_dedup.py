"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

Texts are lower-cased (A-Z) and split at blanks; a document is the set of its distinct shingles
of five words (with one to four words, the whole sequence is its one shingle). Documents of equal
sets are one class from the start. Every class has a SuperMinHash signature (Ertl 2017): each
shingle draws a random permutation of the slots, its rank there plus a fraction competes for the
slot, and the draws stop as soon as no later rank can win. Equal bands of a signature make a
bucket, in which each class meets the bucket's representative; pairs are confirmed on the full
shingle sets, and confirmed links are united. Members of a bucket that are still in different
groups are then compared with each other in blocks that report only links which join two groups,
so no link inside a bucket is lost and what is written stays in proportion to the members.

Defined results: a null or blank text has no shingle, is its own group and is linked to nothing;
repeated rows and exact copies share a group; a row without doc_id is a group of its own without
a name; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import GOLDEN, WordHashes, lower_words, mixed, pieces, rolled, signed, text_batches, text_bytes, trimmed
from logsift.operators.components import connected_components
from logsift.scratch import discard, hot_keys, join_dealt, materialize

SHINGLE = 5
THRESHOLD = 85
# 32 bands of 5 slots: a pair at the threshold of 0.85 is missed with a chance below 1e-8, at 0.80
# with one of 3e-6.
BANDS, SLOTS = 32, 5
# Text whose shingles draw together; each may need a permutation of the slots of its own.
PIECE_BYTES = 1 << 18
# A pair is looked at in full unless fewer slots agree than so many standard deviations (of
# independent slots; SuperMinHash has smaller ones) below the threshold.
DEVIATIONS = 5.5
# Members of a bucket on either side of a block, and most pairs of one key in one task.
BLOCK = 256
HOT_PAIRS = 1000


def shingle_set(text: bytes | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, none without words."""
    words = lower_words(text)
    if not words:
        return np.empty(0, np.uint64)
    values = hashes.of(words)
    if len(words) < size:
        return mixed(rolled(values, len(words)) ^ np.uint64(len(words)))
    return np.unique(rolled(values, size))


def superminhash(values: np.ndarray, owner: np.ndarray, n: int, slots: int) -> np.ndarray:
    """Signatures, an (n, slots) array, of n sets given as elements with the number of their set.

    An entry holds the winning rank in its upper and the fraction in its lower 32 bits. All
    elements draw their next rank together; sets whose slots hold only lower ranks leave.
    """
    out = np.full((n, slots), np.iinfo(np.uint64).max, np.uint64)
    flat = out.reshape(-1)
    low = np.uint64(0xFFFFFFFF)
    order = None
    with np.errstate(over="ignore"):
        for rank in range(slots):
            draw = mixed(values + GOLDEN * np.uint64(rank + 1))
            pick = rank + ((draw >> np.uint64(32)) * np.uint64(slots - rank) >> np.uint64(32)).astype(np.int64)
            if rank:
                rows = np.arange(len(values))
                slot = order[rows, pick].astype(np.int64)
                order[rows, pick] = order[rows, rank]
            else:
                slot = pick
            key = (draw & low) | np.uint64(rank) << np.uint64(32)
            np.minimum.at(flat, owner * slots + slot, key)
            stay = (out.max(axis=1) >> np.uint64(32)) > rank
            stay = stay[owner]
            if not stay.any():
                break
            if rank == 0:
                kind = np.uint8 if slots <= 256 else np.uint16
                order = np.tile(np.arange(slots, dtype=kind), (int(stay.sum()), 1))
                order[np.arange(len(order)), pick[stay]] = 0
            elif not stay.all():
                order = order[stay]
            values, owner = values[stay], owner[stay]
    return out


SIGNED = "row long, doc_id long, n_shingles long, low long, high long, bands array<long>, sketch binary"


def signatures(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, slots: int = SLOTS) -> DataFrame:
    """(row, doc_id, n_shingles, low, high, bands, sketch) of every row of ``docs``.

    ``row`` numbers the rows, ``low`` and ``high`` are a digest of the set, ``bands`` a hash per
    band (null without words), ``sketch`` one byte per slot.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, width, row = WordHashes(), bands * slots, TaskContext.get().partitionId() << 33
        for batch in pieces(batches, PIECE_BYTES):
            with np.errstate(over="ignore"):
                sets = [shingle_set(text, hashes, size) for text in batch.column(1).to_pylist()]
                sizes = np.array([len(s) for s in sets])
                digests = np.array(
                    [(mixed(s).sum(), mixed(s + GOLDEN).sum()) for s in sets], np.uint64
                ).reshape(-1, 2)
                found = superminhash(
                    np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), width
                )
                fine = mixed(found)
                parts = fine.reshape(len(sets), bands, slots)
                keys = parts[:, :, 0].copy()
                for i in range(1, slots):
                    keys = keys * GOLDEN + parts[:, :, i]
                keys = mixed(keys + np.arange(bands, dtype=np.uint64))
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
            bytes_of = fine.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + len(sets))),
                    batch.column(0).cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(signed(np.ascontiguousarray(digests[:, 0]))),
                    pa.array(signed(np.ascontiguousarray(digests[:, 1]))),
                    pa.ListArray.from_arrays(
                        pa.array(offsets),
                        pa.array(signed(keys[sizes > 0].reshape(-1))),
                        mask=pa.array(sizes == 0),
                    ),
                    pa.array([row.tobytes() for row in bytes_of], pa.binary()),
                ],
                names=["row", "doc_id", "n_shingles", "low", "high", "bands", "sketch"],
            )
            row += len(sets)

    return text_bytes(docs).mapInArrow(trimmed(rows), SIGNED)


def _agreement(a: pa.Array, b: pa.Array) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(len(c), -1) for c in (a, b))
    return (x == y).mean(axis=1)


def least_agreement(threshold: int, slots: int) -> float:
    """Share of equal slots below which a pair does not reach the threshold."""
    p = threshold / 100
    return p - DEVIATIONS * np.sqrt(p * (1 - p) / slots)


def _likely(threshold: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                slots = len(batch.column(2)[0].as_py())
                keep = _agreement(batch.column(2), batch.column(3)) >= least_agreement(threshold, slots)
                yield batch.select([0, 1]).filter(pa.array(keep))

    return rows


def _sized(threshold: int):
    """Sets whose sizes alone do not rule the threshold out."""
    small, large = F.least("n_u", "n_v"), F.greatest("n_u", "n_v")
    return F.lit(100) * small >= F.lit(threshold) * large


def _with_both(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs (u, v) with the columns of both ends as <name>_u and <name>_v.

    Keys in many pairs are dealt out over several tasks by their number of pairs. ``rows`` holds
    ids that may occur in pairs, not all documents.
    """
    for end in ("u", "v"):
        counts = pairs.groupBy(end).agg(F.count("*").alias("_rows"))
        right = materialize(
            rows.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in columns]).join(counts, end),
            "ends",
        )
        hot = hot_keys(right, [end], "_rows", HOT_PAIRS)
        pairs = join_dealt(pairs, right, [end], "_rows", hot, HOT_PAIRS).drop("_rows")
    return pairs


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """The pairs (u, v) whose full shingle sets reach the threshold; ``texts`` is (id, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), {}
        for batch in batches:
            keep = []
            for u, v, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if v not in seen:  # rows come sorted by v, so this end is read once
                    seen = {v: shingle_set(b, hashes, size)}
                x, y = shingle_set(a, hashes, size), seen[v]
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    joined = _with_both(pairs, texts, ["text"]).sortWithinPartitions("v")
    return joined.select("u", "v", "text_u", "text_v").mapInArrow(trimmed(rows), "u long, v long")


def _candidates(group: pa.Table, threshold: int) -> np.ndarray:
    """Members of a block with a partner in another group that sizes and sketches allow.

    Of the buckets that two members share only the first one counts.
    """
    roots, sizes, chunk = (group.column(c).to_numpy() for c in ("root", "n", "chunk"))
    sketch = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(roots), -1)
    bands = np.array(group.column("bands").to_pylist(), np.int64)
    here = bands[0] == group.column("key")[0].as_py()
    earlier = bands[:, : int(np.flatnonzero(here)[0])]
    first, second = group.column("i")[0].as_py(), group.column("j")[0].as_py()
    least = least_agreement(threshold, sketch.shape[1])
    involved = np.zeros(len(roots), bool)
    for x in np.flatnonzero(chunk == second):
        other = np.flatnonzero((chunk == first) & (roots != roots[x]))
        small, large = np.minimum(sizes[other], sizes[x]), np.maximum(sizes[other], sizes[x])
        other = other[100 * small >= threshold * large]
        other = other[(sketch[other] == sketch[x]).mean(axis=1) >= least]
        other = other[~(earlier[other] == earlier[x]).any(axis=1)]
        if len(other):
            involved[x] = True
            involved[other] = True
    return involved


def _involved(threshold: int):
    def block(group: pa.Table) -> pa.Table:
        keep = _candidates(group, threshold)
        return group.select(["key", "i", "j", "id", "root"]).filter(pa.array(keep))

    return block


def _joining(size: int, threshold: int):
    """Links (u, v) of a block, one for each two groups that it joins."""

    def block(group: pa.Table) -> pa.Table:
        hashes, parent = WordHashes(), {}

        def find(x):
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        ids, roots = group.column("id").to_pylist(), group.column("root").to_pylist()
        sets = [shingle_set(t, hashes, size) for t in group.column("text").to_pylist()]
        sizes = np.array([len(s) for s in sets])
        _, local = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes
        marked = np.zeros(int(local.max()) + 1, bool)
        common = max(set(roots), key=roots.count)
        links = []
        # Two members of the most common group need no look, so the loop is over the others.
        for x in (k for k, root in enumerate(roots) if root != common):
            if len({find(r) for r in roots}) == 1:
                break
            mine = local[starts[x] : starts[x] + sizes[x]]
            marked[mine] = True
            both = np.add.reduceat(marked[local], starts, dtype=np.int64)
            marked[mine] = False
            for y in np.flatnonzero(100 * both >= threshold * (sizes + sizes[x] - both)):
                a, b = find(roots[x]), find(roots[y])
                if a != b:
                    parent[a] = b
                    links.append((min(ids[x], ids[y]), max(ids[x], ids[y])))
        us, vs = zip(*links, strict=True) if links else ([], [])
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    return block


def _left_open(met: DataFrame, groups: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    """Links between members of one bucket that are in different groups.

    The head of a bucket has met everyone and takes no part. Members outside the largest group of
    their bucket are dealt into chunks that meet each other and all chunks of the largest group.
    """
    members = materialize(
        met.where("rows > 2 and id <> head")
        .select("key", "id")
        .join(groups, "id", "left")
        .select("key", "id", F.coalesce("root", "id").alias("root")),
        "open",
    )
    per_root = members.groupBy("key", "root").agg(F.count("*").alias("n"))
    chunks = lambda n: F.ceil(n / F.lit(BLOCK)).cast("int")
    split = (
        per_root.groupBy("key")
        .agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("all"), F.count("*").alias("roots"))
        .where("roots > 1")
        .select(
            "key",
            F.col("main.root").alias("main"),
            chunks(F.col("main.n")).alias("mains"),
            chunks(F.col("all") - F.col("main.n")).alias("others"),
        )
    )
    is_main, draw = F.col("root") == F.col("main"), F.xxhash64("id")
    chunk = F.when(is_main, F.pmod(draw, F.col("mains"))).otherwise(
        F.col("mains") + F.pmod(draw, F.col("others"))
    )
    last = F.col("mains") + F.col("others") - F.lit(1)
    partner = F.explode(F.sequence(F.when(is_main, F.col("mains")).otherwise(F.lit(0)), last))
    dealt = (
        members.join(split, "key")
        .withColumn("chunk", chunk.cast("int"))
        .withColumn("partner", partner)
        .select("key", "id", "root", "chunk", F.least("chunk", "partner").alias("i"), F.greatest("chunk", "partner").alias("j"))
    )
    involved = materialize(
        dealt.join(nodes, "id")
        .groupBy("key", "i", "j")
        .applyInArrow(_involved(threshold), "key long, i int, j int, id long, root long"),
        "involved",
    )
    return materialize(
        involved.join(texts, "id")
        .groupBy("key", "i", "j")
        .applyInArrow(_joining(size, threshold), "u long, v long"),
        "links",
    )


def near_duplicates(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    size: int = SHINGLE,
    bands: int = BANDS,
    slots: int = SLOTS,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents linked at the threshold.

    The group is named by its smallest doc_id, which is the document kept.
    """
    with text_batches(docs.sparkSession):
        sets = materialize(signatures(docs, size, bands, slots), "signed")
    keys = ["low", "high", "n_shingles"]
    linkable = F.col("n_shingles") > 0
    full = sets.where(linkable & F.col("doc_id").isNotNull())
    classes = materialize(
        full.groupBy(*keys).agg(
            F.min(F.struct(F.col("doc_id").alias("id"), "row")).alias("first"), F.count("*").alias("_rows")
        ).select(*keys, "first.id", "first.row", "_rows"),
        "classes",
    )
    hot = hot_keys(classes, keys, "_rows")
    alone = sets.where(~linkable | F.col("doc_id").isNull())
    members = materialize(
        join_dealt(full.select("doc_id", *keys), classes.drop("row"), keys, "_rows", hot)
        .select("doc_id", "n_shingles", "id")
        .union(alone.select("doc_id", "n_shingles", F.col("doc_id").alias("id"))),
        "members",
    )
    # One row per class, the first of its smallest id.
    nodes = full.join(classes.select("row", "id"), "row").select("id", F.col("n_shingles").alias("n"), "bands", "sketch")
    nodes = materialize(nodes, "nodes")
    discard(sets)

    # The key numbers its band too. The head of a bucket is its smallest id in an order of the key's own.
    buckets = nodes.select("id", F.explode("bands").alias("key"))
    heads = buckets.groupBy("key").agg(
        F.min(F.col("id").bitwiseXOR(F.col("key"))).alias("least"), F.count("*").alias("rows")
    )
    heads = heads.where("rows > 1").select("key", F.col("least").bitwiseXOR(F.col("key")).alias("head"), "rows")
    met = materialize(buckets.join(heads, "key"), "buckets")

    # From here on only classes that share a bucket matter. Their texts are picked out once; the
    # number of such classes grows with the input, so they are joined and not broadcast.
    ids = met.select("id").distinct()
    near = materialize(nodes.join(ids.hint("merge"), "id"), "near")
    discard(nodes)
    texts = text_bytes(docs).select(F.col("doc_id").alias("id"), "text").join(ids.hint("merge"), "id")
    texts = materialize(texts.dropDuplicates(["id"]) if _repeats(members) else texts, "texts")

    stars = met.where("id <> head").select(F.least("id", "head").alias("u"), F.greatest("id", "head").alias("v"))
    links = _links(stars.distinct(), near, texts, size, threshold)
    more = _left_open(met, _groups(links), near, texts, size, threshold)
    groups = _groups(links.union(more))
    return (
        members.join(groups, "id", "left")
        .select("doc_id", "n_shingles", F.coalesce("root", "id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _repeats(members: DataFrame) -> bool:
    """True if a doc_id has several rows, which then count once as a text."""
    return not members.groupBy("doc_id").count().where("count > 1 and doc_id is not null").isEmpty()


def _links(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, size: int, threshold: int) -> DataFrame:
    pairs = materialize(pairs, "pairs")
    likely = (
        _with_both(pairs, nodes, ["n", "sketch"])
        .where(_sized(threshold))
        .select("u", "v", "sketch_u", "sketch_v")
        .mapInArrow(trimmed(_likely(threshold)), "u long, v long")
    )
    likely = materialize(likely, "likely")
    with text_batches(texts.sparkSession):
        return materialize(confirmed(likely, texts, size, threshold), "links")


def _groups(links: DataFrame) -> DataFrame:
    """(id, root) of the linked ids alone."""
    ids = links.select(F.col("u").alias("id")).union(links.select(F.col("v").alias("id"))).distinct()
    return connected_components(materialize(ids, "linked"), links)
