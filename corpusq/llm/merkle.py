"""Merkle manifest of a dataset: butterfly exchange of subtree roots between aligned groups of partitions.

Leaves are put in order and cut into partitions of ``fanout ** block_levels`` neighbours. Each partition
hashes its own subtree. Then, round by round, the partitions of ``fanout`` neighbouring subtrees swap
their roots: a partition receives the other roots of its run and hashes the ancestor itself, as do all
partitions below that ancestor. When one root is left, each partition holds the upper part of its
proofs; nothing has to be sent down the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq.llm.common import staged
from corpusq.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = "array<struct<before: string, after: string>>"
# monotonically_increasing_id: the partition above this bit, the place in it below.
PLACE_BITS = 33
# Tops of groups that go to every executor, a few KB each.
MAX_TOPS = 10_000


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(columns: Iterable[Column]) -> Column:
    """Hash of all values, each with its length, so that no two rows look alike."""
    parts = []
    for c in columns:
        value = c.cast("string")
        parts.append(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def next_level(nodes: list[str], fanout: int) -> list[str]:
    return [digest("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]


def subtree(nodes: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """All levels from the leaves up: ``levels`` of them, or until one node remains."""
    tree = [nodes]
    while len(tree) <= levels if levels is not None else len(tree[-1]) > 1:
        tree.append(next_level(tree[-1], fanout))
    return tree


def siblings(tree: list[list[str]], place: int, fanout: int) -> list[tuple[str, str]]:
    """Per level what stands before and after the node at ``place`` in its run."""
    found = []
    for nodes in tree[:-1]:
        start = place - place % fanout
        found.append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + fanout])))
        place //= fanout
    return found


def fold(leaf: str, proof: Iterable[tuple[str, str]]) -> str:
    """Root that a leaf and its proof lead to. A level without siblings hashes a lone node."""
    for before, after in proof:
        leaf = digest(before + leaf + after)
    return leaf


def _ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds ``at``, the place inside ``key`` by ``order``, and ``n``, the rows of the key.

    One range sort over all keys; then only counts per key and partition are added up, so a
    key with most of the rows lies in many partitions.
    """
    cols = ["key", *order]
    sorted_rows = rows.repartitionByRange(*cols).sortWithinPartitions(*cols)
    placed = staged(sorted_rows.withColumn("_id", F.monotonically_increasing_id()), name)
    part = F.shiftright("_id", PLACE_BITS)
    placed = placed.withColumns({"_part": part, "_place": F.col("_id") - F.shiftleft(part, PLACE_BITS)})
    counts = placed.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    whole = Window.partitionBy("key")
    so_far = F.sum("_n").over(whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    starts = counts.select("key", "_part", (so_far - F.col("_first")).alias("_start"), F.sum("_n").over(whole).alias("n"))
    return (
        placed.join(cut_lineage(starts), ["key", "_part"])
        .withColumn("at", F.col("_place") + F.col("_start"))
        .drop("_id", "_part", "_place", "_start")
    )


def _blocks(ranked: DataFrame, payload: list[str], width: int, name: str) -> DataFrame:
    """(key, block, blocks, nodes): runs of ``width`` neighbours as one row each."""
    rows = ranked.withColumn("block", F.expr(f"at div {width}"))
    nodes = F.sort_array(F.collect_list(F.struct("at", "leaf", *payload)))
    grouped = rows.groupBy("key", "block").agg(F.first("n").alias("n"), nodes.alias("nodes"))
    return staged(grouped.select("key", "block", F.ceil(F.col("n") / width).alias("blocks"), "nodes"), name)


def _roots(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                subtree(nodes, fanout, levels if count > 1 else None)[-1][0]
                for nodes, count in zip(batch["leaves"].to_pylist(), batch["blocks"].to_pylist(), strict=True)
            ]
            names = ["key", "block", "blocks", "root"]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.string())], names=names)

    leaves = blocks.select("key", "block", "blocks", F.transform("nodes", lambda x: x["leaf"]).alias("leaves"))
    return leaves.mapInArrow(roots, "key string, block long, blocks long, root string")


def _butterfly(roots: DataFrame, fanout: int, name: str) -> DataFrame:
    """(key, block, blocks, root, upper): the root of the key, and the way up to it from the block.

    In round r a partition sends its root to the partitions that differ from it in digit r of
    their number, written to base ``fanout``. At the right edge a subtree may have fewer
    partitions than its neighbours; those it has then share the sending, so that each partition
    still receives each root of its run once: at most ``fanout`` rows.
    """
    state = staged(roots.withColumn("upper", F.expr(f"cast(array() AS {LEVELS})")), f"{name}-0")
    most = state.agg(F.max("blocks")).first()[0] or 0
    span, turn = 1, 0
    while span < most:
        turn += 1
        node = f"block div {span}"
        members = f"least({span}, blocks - t * {span})"
        mine = f"least({span}, blocks - ({node}) * {span})"
        run = f"({node}) - ({node}) % {fanout}"
        targets = F.expr(
            f"flatten(transform(sequence({run}, least({run} + {fanout - 1}, (blocks - 1) div {span})), t -> "
            f"if(block % {span} < {members}, transform(sequence(block % {span}, {members} - 1, {mine}), "
            f"b -> t * {span} + b), array())))"
        )
        active = state.where(F.col("blocks") > span)
        digit = F.expr(f"({node}) % {fanout}").alias("digit")
        sent = active.select("key", F.explode(targets).alias("block"), digit, "root")
        kept = active.select("key", "block", digit, F.lit(None).cast("string").alias("root"), "blocks", "upper")
        nothing = {"blocks": F.lit(None).cast("long"), "upper": F.lit(None).cast(LEVELS)}
        met = sent.withColumns(nothing).unionByName(kept).groupBy("key", "block").agg(
            F.max("blocks").alias("blocks"),
            F.first("upper", ignorenulls=True).alias("upper"),
            F.max(F.when(F.col("blocks").isNotNull(), F.col("digit"))).alias("own"),
            F.sort_array(F.collect_list(F.when(F.col("root").isNotNull(), F.struct("digit", "root")))).alias("run"),
        )

        def text(x: Column) -> Column:
            return F.array_join(F.transform(x, lambda r: r["root"]), "")

        before = text(F.filter("run", lambda r: r["digit"] < F.col("own")))
        after = text(F.filter("run", lambda r: r["digit"] > F.col("own")))
        step = F.array(F.struct(before.alias("before"), after.alias("after")))
        climbed = met.select(
            "key", "block", "blocks", F.sha2(text(F.col("run")), 256).alias("root"), F.concat("upper", step).alias("upper")
        )
        state = staged(climbed.unionByName(state.where(F.col("blocks") <= span)), f"{name}-{turn}")
        span *= fanout
    return state


def manifest(
    docs: DataFrame,
    fields: Iterable[str] = FIELDS,
    id_col: str = "doc_id",
    group_col: str = "lang",
    found: dict[str, Column] | None = None,
    fanout: int = 8,
    block_levels: int = 3,
    with_proof: bool = False,
) -> DataFrame:
    """One row per document: id, leaf, subroot of its group, root, proof_sha256, folded_root, verified.

    A leaf is the sha256 of all ``fields``, each '-' if null, else its length in bytes, ':' and
    its value. Per group leaves ascend by id; every ``fanout`` neighbours become one node until
    one is left, the subroot; subroots in the order of their groups likewise become the root.
    ``found`` holds expressions over ``docs`` for the values of fields met later: folded_root is
    what these lead to with the siblings of the manifest, verified whether that is the root.
    ``with_proof`` adds ``proof``: per level the hashes before and after, joined. proof_sha256 is
    the hash of all of them.

    Null groups and null ids come first; rows of one id stand in the order of their leaves, so
    the result is the same for every partitioning. A single row is its own subroot and root, with
    an empty proof. Any column may be null. Other columns are not read. An empty table gives an
    empty result. Texts do not move: only hashes are sorted and exchanged, in groups of at most
    ``fanout ** block_levels`` leaves or ``fanout`` roots.
    """
    fields = list(fields)
    found = found or {}
    width = fanout**block_levels
    group = F.col(group_col).cast("string")
    leaf = leaf_of([F.col(f) for f in fields])
    later = leaf_of([found.get(f, F.col(f)) for f in fields]) if found else leaf
    hashes = docs.select(
        F.coalesce(F.concat(F.lit("1"), group), F.lit("0")).alias("key"),
        F.col(id_col).alias("id"), leaf.alias("leaf"), later.alias("later"),
    )
    ranked = _ranked(staged(hashes, "merkle-leaves"), ["id", "leaf"], "merkle-ranked")
    blocks = _blocks(ranked, ["id", "later"], width, "merkle-blocks")
    lower = _butterfly(_roots(blocks, fanout, block_levels), fanout, "merkle-round")

    # The subroots are the leaves of one more tree of the same kind.
    subroots = lower.where("block = 0").select(F.lit("").alias("key"), F.col("key").alias("id"), F.col("root").alias("leaf"))
    heads = _blocks(_ranked(subroots, ["id"], "merkle-heads"), ["id"], width, "merkle-head-blocks")
    upper = _butterfly(_roots(heads, fanout, block_levels), fanout, "merkle-head-round")
    levels_type = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                nodes = row["nodes"]
                tree = subtree([x["leaf"] for x in nodes], fanout, block_levels if row["blocks"] > 1 else None)
                higher = [(x["before"], x["after"]) for x in row["upper"]]
                own = [siblings(tree, i, fanout) + higher for i in range(len(nodes))]
                above = pa.array([[{"before": b, "after": a} for b, a in w] for w in own], levels_type)
                columns = [pa.array([x["id"] for x in nodes], pa.string()), above, pa.array([row["root"]] * len(nodes), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "above", "top"])

    tops = heads.join(upper.drop("key", "blocks"), "block").mapInArrow(ways, f"key string, above {LEVELS}, top string")
    tops = cut_lineage(tops)
    if tops.count() <= MAX_TOPS:
        tops = F.broadcast(tops)
    way = lower.join(tops, "key").select(
        "key", "block", F.col("root").alias("subroot"), F.concat("upper", "above").alias("way"), F.col("top").alias("root")
    )
    id_type = docs.schema[id_col].dataType
    schema = f"id {id_type.simpleString()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    schema += f", proof {LEVELS}" if with_proof else ""

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                nodes = one["nodes"].flatten()
                leaves, laters = nodes.field("leaf").to_pylist(), nodes.field("later").to_pylist()
                tree = subtree(leaves, fanout, block_levels if one["blocks"][0].as_py() > 1 else None)
                higher = [(x["before"], x["after"]) for x in one["way"][0].as_py()]
                tail = "".join(b + a for b, a in higher)
                sums, folded, whole = [], [], []
                for place, leaf in enumerate(laters):
                    own = siblings(tree, place, fanout)
                    sums.append(digest("".join(b + a for b, a in own) + tail))
                    folded.append(fold(leaf, own + higher))
                    if with_proof:
                        whole.append([{"before": b, "after": a} for b, a in own + higher])
                columns = [nodes.field("id"), pa.array(leaves, pa.string())]
                columns += [pa.array([one[c][0].as_py()] * len(leaves), pa.string()) for c in ("subroot", "root")]
                columns += [pa.array(sums, pa.string()), pa.array(folded, pa.string())]
                columns += [pa.array(whole, levels_type)] if with_proof else []
                names = ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "proof"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = blocks.join(way, ["key", "block"]).select("nodes", "blocks", "way", "subroot", "root").mapInArrow(proofs, schema)
    return rows.withColumn("verified", F.col("folded_root") == F.col("root")).withColumnRenamed("id", id_col)
