"""Merkle manifest of a documents table: one tree per source, a tree over the sources, and a proof for every row.

A tree has ``FANOUT`` children per node. Conditional aggregates spread the children of a node into so many columns: the
concatenation of these columns is what the node hashes, and without a child's own column it is that child's siblings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tempolog.llm.common import durable

FANOUT = 16
TAMPERED = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SLOTS = [f"s{j}" for j in range(FANOUT)]
_PATH = "array<struct<left:string,right:string>>"


def _hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(fields: list[Column]) -> Column:
    """The digest of a row: its values in order, each by its length in bytes, a colon and itself; a null by a dash."""
    texts = [x.cast("string") for x in fields]
    return _hash(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]))


def _leaves(docs: DataFrame) -> DataFrame:
    """``(tree, doc_id, leaf, tampered)`` per row; trees are named so that a null source comes first.

    ``tampered`` is the digest with lower-cased text where the row is chosen for tampering, else null.
    """
    rows = docs.select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in rows.columns]
    changed = leaf_hash([*fields[:-1], F.translate("text", _UPPER, _LOWER)])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    return rows.select(F.coalesce(F.concat(F.lit("+"), "source"), F.lit("")).alias("tree"), "doc_id", leaf_hash(fields).alias("h"),
                       F.when(chosen, changed).alias("tampered"))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 within ``group`` by ``order``, and ``n``, the rows of the group.

    Ranges of (group, order) are tasks, so that a group of any size is spread over many; only counts per group and range are
    summed up. Rows that are equal in ``order`` are numbered in any way.
    """
    spread = rows.withColumn("_row", F.monotonically_increasing_id())
    keys = [group, *order, "_row"]
    cut = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
    cut = durable(cut.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()))
    own = Window.partitionBy(group)
    parts = cut.groupBy(group, "_range").agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    starts = parts.select(group, "_range", F.sum("_rows").over(own).alias("n"),
                          (F.sum("_rows").over(own.orderBy("_range")) - F.col("_rows") - F.col("_first")).alias("_start"))
    return cut.join(starts, [group, "_range"]).withColumn("idx", F.col("_place") + F.col("_start")).drop("_range", "_place", "_start")


def _runs(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """One row per run of ``FANOUT`` nodes of a tree: its children in columns, and the digest that stands for it.

    ``n`` is the number of nodes the tree has on the children's level; a tree of one node keeps its digest.
    """
    child = F.struct("h", *carried)
    slots = [F.max(F.when(F.col("idx") % FANOUT == j, child)).alias(s) for j, s in enumerate(_SLOTS)]
    runs = nodes.groupBy("tree", F.expr(f"idx div {FANOUT}").alias("run")).agg(F.max("n").alias("n"), *slots)
    joined = F.concat_ws("", *[f"{s}.h" for s in _SLOTS])
    return runs.withColumn("h", F.when(F.col("n") == 1, F.col("s0.h")).otherwise(_hash(joined)))


def _grow(nodes: DataFrame, carried: list[str] = []) -> list[DataFrame]:
    """The levels of runs over ``nodes`` (``tree``, ``idx``, ``n``, ``h``), from the lowest, until every tree is one digest."""
    left = nodes.agg(F.max("n")).first()[0] or 0
    levels = []
    while not levels or left > 1:
        levels.append(durable(_runs(nodes, carried)))
        nodes, carried = levels[-1].select("tree", F.col("run").alias("idx"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), "h"), []
        left = (left + FANOUT - 1) // FANOUT
    return levels


def _unfold(levels: list[DataFrame], above: DataFrame, carried: list[str], kept: list[str]) -> DataFrame:
    """Children of the lowest level as ``(tree, idx, h, path, *carried, *kept)``.

    ``above`` has the ``path`` and further columns of every tree's last digest; a path lists the siblings left and right of
    a node and of what it hashes into, from its own level upwards.
    """
    nodes = above.select("tree", F.lit(0).cast("long").alias("idx"), "path", *kept)
    for k, level in reversed(list(enumerate(levels))):
        more = carried if k == 0 else []
        runs = level.drop("h").join(nodes.withColumnRenamed("idx", "run"), ["tree", "run"])
        own = [F.concat_ws("", *[f"{s}.h" for s in part]) if part else F.lit("") for j in range(FANOUT) for part in (_SLOTS[:j], _SLOTS[j + 1:])]
        children = F.array(*[F.struct(F.lit(j).alias("slot"), F.col(s).alias("node"), F.struct(own[2 * j].alias("left"), own[2 * j + 1].alias("right")).alias("step"))
                             for j, s in enumerate(_SLOTS)])
        found = runs.select("tree", "run", "n", "path", *kept, F.explode(children).alias("c")).where("c.node is not null")
        path = F.when(F.col("n") > 1, F.concat(F.array("c.step"), "path")).otherwise(F.col("path"))
        nodes = found.select("tree", (F.col("run") * FANOUT + F.col("c.slot")).alias("idx"), F.col("c.node.h").alias("h"), path.alias("path"),
                             *kept, *[F.col(f"c.node.{c}").alias(c) for c in more])
    return nodes


def manifest(docs: DataFrame) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` for every row of ``docs``.

    Leaves of a source ascend by doc_id (null first; rows that repeat a doc_id by their digest, so equal rows are
    interchangeable); a null source is a source of its own, the first. A null value is a dash. A row without doc_id is never
    tampered with. An empty table has no rows. Only doc_id, source, lang, n_chars and text enter the digests.

    Digests of the rows are written once; levels of the trees are aggregated one after the other, each a sixteenth of the
    one below. No source, level or proof is gathered: the largest row holds one run of sixteen children.
    """
    leaves = numbered(durable(_leaves(docs)), "tree", ["doc_id", "h"])
    levels = _grow(leaves, ["doc_id", "tampered"])
    subroots = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("source"), "h")
    top = _grow(numbered(subroots, "tree", ["source"]), ["source"])
    root = top[-1].select("h").first()
    start = top[-1].select("tree", F.array().cast(_PATH).alias("path"))
    sources = _unfold(top, start, ["source"], []).select(F.col("source").alias("tree"), "path", F.col("h").alias("subroot"))
    rows = _unfold(levels, sources, ["doc_id", "tampered"], ["subroot"])
    folded = F.aggregate("path", F.coalesce("tampered", "h"), lambda h, step: _hash(F.concat(step["left"], h, step["right"])))
    proof = _hash(F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), ""))
    out = rows.select("doc_id", F.col("h").alias("leaf"), "subroot", F.lit(root[0] if root else "").alias("root"), proof.alias("proof_sha256"),
                      folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
