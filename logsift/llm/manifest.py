"""Merkle manifest of a table of documents, with a proof for every row.

Each row is a leaf: the hash of its columns. The leaves of a language ascend by doc_id and every
ARITY consecutive nodes have one parent, up to the subroot of the language; the subroots, ordered by
language, have parents in the same way up to the root. Every level that is built is written as
node rows (identity, hash, hashes of the children, pointer to the parent). One recursive query then
climbs these rows: each step joins the parents, appends the siblings to the proof and folds the
hash that the leaf has now, tampered or not, into the hash of the parent.

Leaves of one run share all siblings above it, so the rows that climb are runs: they hold one proof
and the folded hash of each leaf. A node is written in one copy for SHARED runs below it and each
run meets one of them, so no join key gathers more, not even the root's.

Defined results: a null column counts as null; rows without doc_id come first in their language
and are never tampered with; rows that repeat are leaves of their own, in any order, as their
hashes are equal; the proof of a sole leaf is the hash of nothing; an empty table gives no row.
Columns other than the five hashed ones play no part.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from logsift.scratch import materialize, number_rows, place_columns

ARITY = 8
# Runs that meet the same copy of a node.
SHARED = 64
HASHED = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of a hash.
_SIZE = 32
_ROW_LIMIT = "spark.sql.cteRecursionRowLimit"
_NODE = ("tree", "level", "at", "size", "hash", "children", "runs")

CLIMB = """
WITH RECURSIVE climb AS (
  SELECT tree AS run_tree, at AS run_at, p_tree, p_level, p_at, place,
    pmod(xxhash64(tree, at), p_copies) AS copy, hash, CAST(NULL AS BINARY) AS subroot, folded,
    CAST('' AS BINARY) AS proof
  FROM {base}
  UNION ALL
  SELECT c.run_tree, c.run_at, n.p_tree, n.p_level, n.p_at, n.place,
    pmod(xxhash64(c.run_tree, c.run_at), n.p_copies), n.hash,
    CASE WHEN c.subroot IS NULL AND n.tree = 0
      THEN substring(n.children, {size} * c.place + 1, {size}) ELSE c.subroot END,
    transform(c.folded, f -> unhex(sha2(concat(
      lower(hex(substring(n.children, 1, {size} * c.place))), lower(hex(f)),
      lower(hex(substring(n.children, {size} * c.place + {size} + 1)))), 256))),
    concat(c.proof, substring(n.children, 1, {size} * c.place),
      substring(n.children, {size} * c.place + {size} + 1))
  FROM climb AS c JOIN {nodes} AS n
    ON c.p_tree = n.tree AND c.p_level = n.level AND c.p_at = n.at AND c.copy = n.copy
)
SELECT run_tree, run_at, hash AS root, coalesce(subroot, hash) AS subroot, folded, proof
FROM climb WHERE p_tree IS NULL
"""


def field(value: Column) -> Column:
    """A value as it is hashed: ``-`` if null, else its size in bytes, a colon and its text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(text: Column) -> Column:
    cells = [text if c == "text" else F.col(c) for c in HASHED]
    return F.unhex(F.sha2(F.concat(*map(field, cells)).cast("binary"), 256))


def _hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def _node_hash(children: Column) -> Column:
    return F.unhex(F.sha2(_hex(children).cast("binary"), 256))


def _joined(hashes: Column) -> Column:
    """Hashes of an array as one binary."""
    return F.unhex(F.array_join(F.transform(hashes, F.hex), ""))


def _without(children: Column, place: Column) -> tuple[Column, Column]:
    """The hashes before and after ``place``."""
    at = place.cast("int") * _SIZE
    return F.substring(children, F.lit(1), at), F.substring(children, at + _SIZE + 1, F.lit(1 << 30))


def tampered(key: str = "doc_id") -> Column:
    """True for the rows whose text is altered before the check: 3 divides the crc32 of the id as text."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _leaves(docs: DataFrame, altered: Column) -> DataFrame:
    """(tree, at, size, doc_id, leaf, now): every leaf with its place among the leaves of its language.

    Only counts per range and language go through windows and joins.
    """
    lowered = leaf_hash(F.translate("text", _UPPER, _LOWER))
    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        leaf_hash(F.col("text")).alias("leaf"), F.when(altered, lowered).alias("now"),
    )
    hashed = materialize(hashed, "leaves").withColumn("_row", F.monotonically_increasing_id())
    order = ["lang", "doc_id", "leaf", "_row"]
    ranged = hashed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(ranged.drop("_row").select("*", *place_columns()), "placed")
    groups = materialize(
        placed.groupBy("_pid", "lang").agg(F.count("*").alias("_n"), F.min("_pos").alias("_first")), "groups"
    )
    same = Window.partitionBy("lang")
    before = same.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    trees = number_rows(groups.select("lang").distinct(), ["lang"], "tree", first=1)
    offsets = groups.withColumns(
        {
            "_shift": F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"),
            "size": F.sum("_n").over(same),
        }
    ).join(trees.withColumnRenamed("lang", "_lang"), F.col("lang").eqNullSafe(F.col("_lang")))
    offsets = materialize(offsets.select(F.col("_pid").alias("_p"), "_lang", "_shift", "size", "tree"), "offsets")
    found = placed.join(offsets, (F.col("_pid") == F.col("_p")) & F.col("lang").eqNullSafe(F.col("_lang")))
    return found.select(
        "tree", (F.col("_pos") + F.col("_shift")).alias("at"), "size", "doc_id", "leaf",
        F.coalesce("now", "leaf").alias("now"),
    )


def _runs(leaves: DataFrame) -> DataFrame:
    """Runs of ARITY leaves as nodes of level 1; the leaf of a tree of one is its node of level 0."""
    member = F.struct("at", "doc_id", "leaf", "now")
    grouped = (
        leaves.groupBy("tree", F.floor(F.col("at") / ARITY).alias("at"))
        .agg(F.first("size").alias("leaves"), F.array_sort(F.collect_list(member)).alias("members"))
        .withColumn("children", _joined(F.transform("members", lambda m: m["leaf"])))
    )

    def now(member: Column, place: Column) -> Column:
        left, right = _without(F.col("children"), place)
        return F.unhex(F.sha2(F.concat(_hex(left), _hex(member["now"]), _hex(right)).cast("binary"), 256))

    sole = F.col("leaves") == 1
    return grouped.select(
        "tree",
        F.when(sole, 0).otherwise(1).alias("level"),
        "at",
        F.ceil(F.col("leaves") / ARITY).alias("size"),
        F.when(sole, F.col("children")).otherwise(_node_hash(F.col("children"))).alias("hash"),
        "children",
        F.lit(1).cast("long").alias("runs"),
        "members",
        F.when(sole, F.transform("members", lambda m: m["now"])).otherwise(F.transform("members", now)).alias("folded"),
    )


def _pointed(nodes: DataFrame, slot: Column, tree: Column, level: Column) -> DataFrame:
    """Nodes of one level with the pointer to their parents, which gather ARITY neighbouring slots."""
    over = Window.partitionBy("tree" if tree is None else tree, F.floor(slot / ARITY))
    return nodes.withColumns(
        {
            "p_tree": F.col("tree") if tree is None else tree,
            "p_level": level + 1,
            "p_at": F.floor(slot / ARITY),
            "place": (slot % ARITY).cast("int"),
            "p_copies": F.ceil(F.sum("runs").over(over) / SHARED),
        }
    )


def _parents(pointed: DataFrame, size: Column) -> DataFrame:
    """The next level."""
    child = F.struct("place", "hash")
    grouped = pointed.groupBy("p_tree", "p_level", "p_at").agg(
        size.alias("size"), F.sum("runs").alias("runs"), F.array_sort(F.collect_list(child)).alias("kids")
    )
    children = _joined(F.transform("kids", lambda k: k["hash"]))
    return grouped.withColumn("children", children).select(
        F.col("p_tree").alias("tree"), F.col("p_level").alias("level"), F.col("p_at").alias("at"), "size",
        _node_hash(F.col("children")).alias("hash"), "children", "runs",
    )


def _levels(nodes: DataFrame, most: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """(levels with pointers, nodes without parent) from the nodes of one level up to the tops.

    ``most`` is the largest number of nodes that a tree has on this level.
    """
    inner, tops = [], []
    while True:
        tops.append(nodes.where("size = 1"))
        if most <= 1:
            return inner, tops
        more = nodes.where("size > 1")
        pointed = materialize(_pointed(more, F.col("at"), None, F.col("level")), f"{name}_pointed")
        inner.append(pointed)
        nodes = materialize(_parents(pointed, F.ceil(F.first("size") / ARITY)), name)
        most = -(-most // ARITY)


def _all(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def build(docs: DataFrame, altered: Column) -> tuple[DataFrame, DataFrame]:
    """(runs, nodes above them), both written, linked by parent pointers up to the root."""
    runs = materialize(_runs(_leaves(docs, altered)), "runs")
    most = runs.agg(F.max("size")).head()[0] or 0
    inner, tops = _levels(runs.select(*_NODE), most, "level")
    tops = materialize(_all(tops), "subroots")
    trees = tops.count()
    if trees > 1:
        joint = _pointed(tops.withColumn("_trees", F.lit(trees)), F.col("tree") - 1, F.lit(0).cast("long"), F.lit(0))
        joint = materialize(joint, "joint")
        first = materialize(_parents(joint, F.ceil(F.first("_trees") / ARITY)), "upper")
        upper, roots = _levels(first, -(-trees // ARITY), "upper")
        pointed = [*inner, joint.drop("_trees"), *upper, *roots]
    else:
        pointed = [*inner, tops]
    # Every row once: a node that has a parent carries its pointer, the root carries none.
    nodes = materialize(_all([*pointed, _no_pointers(docs.sparkSession)]), "nodes")
    pointers = ["p_tree", "p_level", "p_at", "place", "p_copies"]
    base = nodes.where("tree > 0 and level < 2").select("tree", "level", "at", *pointers)
    runs = runs.join(base, ["tree", "level", "at"])
    above = nodes.where("tree = 0 or level >= 2")
    copies = F.sequence(F.lit(0).cast("long"), F.ceil(F.col("runs") / SHARED) - 1)
    return materialize(runs, "runs_pointed"), materialize(above.withColumn("copy", F.explode(copies)), "nodes_copied")


def _no_pointers(spark: SparkSession) -> DataFrame:
    """No row, but the columns of pointers, which a table of one node has nowhere else."""
    return spark.createDataFrame([], "p_tree long, p_level int, p_at long, place int, p_copies long")


@contextmanager
def _any_number_of_rows(spark: SparkSession):
    """Spark stops recursive queries at a number of rows; runs in climbing are as many as the table has."""
    before = spark.conf.get(_ROW_LIMIT)
    spark.conf.set(_ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(_ROW_LIMIT, before)


def climbed(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(run_tree, run_at, root, subroot, folded, proof) of every run, by one recursive query."""
    spark = runs.sparkSession
    with _any_number_of_rows(spark):
        found = spark.sql(CLIMB.replace("{size}", str(_SIZE)), base=runs, nodes=nodes)
        return materialize(found, "climbed")


def manifest(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs``.

    ``altered`` marks the rows whose text has A-Z lower-cased when the proof is checked.
    """
    runs, nodes = build(docs, tampered() if altered is None else altered)
    met = runs.drop("hash").join(
        climbed(runs, nodes).withColumnRenamed("folded", "at_root"),
        (F.col("tree") == F.col("run_tree")) & (F.col("at") == F.col("run_at")),
    )
    each = met.select(
        "children", "proof", "root", "subroot", "at_root", F.posexplode("members").alias("place_", "member")
    )
    left, right = _without(F.col("children"), F.col("place_"))
    folded = F.col("at_root")[F.col("place_")]
    return each.select(
        F.col("member.doc_id").alias("doc_id"),
        _hex(F.col("member.leaf")).alias("leaf"),
        _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"),
        F.sha2(_hex(F.concat(left, right, "proof")).cast("binary"), 256).alias("proof_sha256"),
        _hex(folded).alias("folded_root"),
        (folded == F.col("root")).alias("verified"),
    )


# The same in DuckDB: crc32 bit by bit, levels and climb by recursion.
SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang, n_chars, text,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered,
    list_reduce(
      list_prepend(4294967295, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k, 1))::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc
  FROM documents
), fields AS (
  SELECT doc_id, lang, crc, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
    || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail, coalesce(strlen(lowered) || ':' || lowered, '-') AS tail_now
  FROM docs
), leaves AS (
  SELECT doc_id, sha256(head || tail) AS leaf,
    CASE WHEN xor(crc, 4294967295) % 3 = 0 THEN sha256(head || tail_now) ELSE sha256(head || tail) END AS now,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) AS tree,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(head || tail)) - 1 AS pos
  FROM fields
), nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS hash, NULL::VARCHAR[] AS kids, count(*) OVER (PARTITION BY tree) AS size FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), list(hash ORDER BY pos), any_value((size + 7) // 8)
  FROM nodes WHERE size > 1 GROUP BY tree, level, pos // 8
), tops AS (
  SELECT tree, level, hash FROM nodes WHERE size = 1
), upper AS (
  SELECT 0 AS level, tree - 1 AS pos, hash, NULL::VARCHAR[] AS kids, count(*) OVER () AS size FROM tops
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), list(hash ORDER BY pos), any_value((size + 7) // 8)
  FROM upper WHERE size > 1 GROUP BY level, pos // 8
), linked AS (
  SELECT tree, level, pos, hash, kids, CASE WHEN size > 1 THEN tree ELSE 0 END AS p_tree,
    CASE WHEN size > 1 THEN level + 1 ELSE 1 END AS p_level,
    CASE WHEN size > 1 THEN pos ELSE tree - 1 END AS slot FROM nodes
  UNION ALL
  SELECT 0, level, pos, hash, kids, 0, level + 1, pos FROM upper WHERE level > 0
), climb AS (
  SELECT l.tree AS t, l.pos AS a, n.p_tree, n.p_level, n.slot, l.now AS folded, '' AS proof
  FROM leaves l JOIN linked n ON n.tree = l.tree AND n.level = 0 AND n.pos = l.pos
  UNION ALL
  SELECT c.t, c.a, n.p_tree, n.p_level, n.slot,
    sha256(array_to_string(n.kids[:c.slot % 8], '') || c.folded || array_to_string(n.kids[c.slot % 8 + 2:], '')),
    c.proof || array_to_string(n.kids[:c.slot % 8], '') || array_to_string(n.kids[c.slot % 8 + 2:], '')
  FROM climb c JOIN linked n ON n.tree = c.p_tree AND n.level = c.p_level AND n.pos = c.slot // 8
), root AS (
  SELECT hash FROM upper WHERE size = 1
), top AS (
  SELECT t, a, folded, proof FROM climb
  WHERE p_tree = 0 AND p_level = (SELECT max(level) + 1 FROM upper)
)
SELECT l.doc_id, l.leaf, s.hash AS subroot, r.hash AS root, sha256(top.proof) AS proof_sha256,
  top.folded AS folded_root, top.folded = r.hash AS verified
FROM leaves l JOIN top ON top.t = l.tree AND top.a = l.pos JOIN tops s ON s.tree = l.tree CROSS JOIN root r
"""
