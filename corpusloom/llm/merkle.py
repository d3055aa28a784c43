"""A Merkle manifest of a dataset: a digest for each row, a proof for each digest, one root.

Rows are leaves; those of a group (a language) are in the order of their ids, and groups of
``fanout`` consecutive nodes become the digest of their concatenated digests, until one is left, the
group's subroot. The subroots, in the order of the groups, make a tree of their own.

A level of a tree is held as one string of fixed-width hex digests. Leaves are cut into aligned
blocks of a power of the fanout, so a parent never has children in two blocks, and each block keeps
its levels as such strings: the substring at a multiple of the width is a node's children, its
digest the parent, and the joined parents are the next level. The substrings that flank a node
among its parent's children are its siblings. The last level of each block is one node, and
these are the leaves of the next round, so the work of a round is that of the one before divided by
the size of a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import keep, numbered

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Levels that a block of leaves climbs: with a fanout of 2, a block is 256 leaves, 32 kB of digests.
BLOCK_LEVELS = 8
WIDTH = 64
NO_PATH = "array<struct<left:string,right:string>>"


def framed(value: Column) -> Column:
    """A value with its length in bytes before it, so that values joined are still told apart."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, values)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and the siblings on its way up give."""
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """Digests of all siblings, from the leaf up and from left to right, as one string."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def _parents(level: Column, fanout: int) -> Column:
    """The next level, from substrings of ``fanout`` digests. Levels are bytes, whose substrings need no scan."""
    run = WIDTH * fanout
    starts = F.sequence(F.lit(1), F.octet_length(level), F.lit(run))
    return F.array_join(F.transform(starts, lambda at: F.sha2(F.substring(level, at, F.lit(run)), 256)), "").cast("binary")


def _step(level: Column, at: Column, fanout: int) -> Column:
    """Siblings of the node at place ``at`` of a level: what flanks it in its run."""
    inside = at % fanout
    left = F.substring(level, ((at - inside) * WIDTH + 1).cast("int"), (inside * WIDTH).cast("int"))
    right = F.substring(level, ((at + 1) * WIDTH + 1).cast("int"), ((fanout - 1 - inside) * WIDTH).cast("int"))
    return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))


def _climb(nodes: DataFrame, carried: Sequence[str], fanout: int, block_levels: int) -> list[DataFrame]:
    """Blocks of each round, from the leaves up.

    ``nodes``: _k (tree), _i (place), _n (nodes of the tree), _h (digest) and the carried columns.
    A block has _k, _b (its number), _n, its nodes in order, and its levels. Trees of one block stop at their
    root; the others go up all levels, even where one node is left, and on to the next round.
    """
    size = fanout**block_levels
    biggest = nodes.agg(F.max("_n")).first()[0] or 0
    rounds = []
    while True:
        block = F.floor(F.col("_i") / size).alias("_b")
        members = F.sort_array(F.collect_list(F.struct("_i", "_h", *carried))).alias("_nodes")
        whole = F.col("_n") <= size

        def next_level(levels: Column, _: Column) -> Column:
            last = F.element_at(levels, -1)
            up = F.array_append(levels, _parents(last, fanout))
            return F.when(whole & (F.octet_length(last) <= WIDTH), levels).otherwise(up)

        first = F.array(F.array_join(F.col("_nodes._h"), "").cast("binary"))
        blocks = nodes.groupBy("_k", block).agg(members, F.max("_n").alias("_n"))
        blocks = keep(blocks.withColumn("_levels", F.aggregate(F.sequence(F.lit(1), F.lit(block_levels)), first, next_level)))
        rounds.append(blocks)
        if biggest <= size:
            return rounds
        biggest = -(-biggest // size)
        above = F.ceil(F.col("_n") / size).alias("_n")
        nodes = blocks.where(~whole).select("_k", F.col("_b").alias("_i"), above, F.element_at("_levels", -1).cast("string").alias("_h"))
        carried = []


def _tops(rounds: Sequence[DataFrame], size: int) -> DataFrame:
    """Root of each tree: _k, _root."""
    found = None
    for blocks in rounds:
        own = blocks.where(F.col("_n") <= size).select("_k", F.element_at("_levels", -1).cast("string").alias("_root"))
        found = own if found is None else found.unionByName(own)
    return found


def _descend(rounds: Sequence[DataFrame], above: DataFrame, carried: Sequence[str], fanout: int, block_levels: int) -> DataFrame:
    """Each leaf with its way up: _k, _i, _h, carried columns, _path, and the other columns of ``above``.

    ``above``: _k, _path (what is beyond the root of the tree), and columns to hand down. Ways go
    down from round to round with one row for each block.
    """
    size = fanout**block_levels
    handed = [c for c in above.columns if c != "_k"]
    nodes = None
    for blocks in reversed(rounds):
        own = blocks.where(F.col("_n") <= size).join(above, "_k")
        if nodes is not None:
            ways = nodes.select("_k", F.col("_i").alias("_b"), *handed)
            own = own.unionByName(blocks.where(F.col("_n") > size).join(ways, ["_k", "_b"]))
        used = F.slice("_levels", F.lit(1), F.size("_levels") - 1)
        others = [c for c in handed if c != "_path"]
        kept = carried if blocks is rounds[0] else []

        def with_way(node: Column, place: Column) -> Column:
            steps = F.transform(used, lambda level, n: _step(level, F.floor(place / F.pow(F.lit(fanout), n)).cast("bigint"), fanout))
            fields = [node[c].alias(c) for c in ("_i", "_h", *kept)]
            return F.struct(*fields, F.concat(steps, F.col("_path")).alias("_path"))

        nodes = own.select("_k", *others, F.inline(F.transform("_nodes", with_way)))
    return nodes


def manifest(
    docs: DataFrame, id_column: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS,
    carry: Sequence[Column] = (), fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """The leaf digest of each row, and its proof.

    Returns the id column, ``carry`` columns (by their names), ``leaf``, ``subroot``, ``root`` and
    ``proof``: for each level from the leaf to the root the digests left and right of the node
    in its run, empty where the run has no others. ``fold(leaf, proof)`` is the root.

    Null values are framed as ``-`` and differ from empty ones. The null group comes first, and so
    do null ids; rows of equal ids are ordered by their digests, and equal rows have leaves and
    proofs each. An empty table has no rows. Columns beside the named ones are not read, whatever
    their names.

    Texts are hashed where they are read. What is shuffled are digests, by ranges for their order
    and then by block, so a language that holds most rows is spread like any other.
    """
    kept = [c.alias(f"_c{i}") for i, c in enumerate(carry)]
    names = docs.select(*carry).columns if carry else []
    columns = [f"_c{i}" for i in range(len(kept))]
    key = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    leaves = keep(docs.select(key.alias("_k"), F.col(id_column).alias("_id"), leaf_digest([F.col(f) for f in fields]).alias("_h"), *kept))
    leaves = numbered(leaves, ["_k"], [F.asc_nulls_first("_id"), F.asc("_h")])
    size = fanout**block_levels
    carried = ["_id", *columns]
    rounds = _climb(leaves, carried, fanout, block_levels)
    # The subroots are the leaves of one more tree.
    subroots = _tops(rounds, size).select(F.lit("").alias("_k"), F.col("_k").alias("_group"), F.col("_root").alias("_h"))
    over = _climb(numbered(subroots, ["_k"], [F.asc("_group")]), ["_group"], fanout, block_levels)
    root = _tops(over, size).withColumn("_path", F.array().cast(NO_PATH))
    groups = _descend(over, root, ["_group"], fanout, block_levels)
    above = groups.select(F.col("_group").alias("_k"), F.col("_h").alias("_subroot"), "_root", "_path")
    found = _descend(rounds, above, carried, fanout, block_levels)
    return found.select(
        F.col("_id").alias(id_column), *[F.col(c).alias(n) for c, n in zip(columns, names)], F.col("_h").alias("leaf"),
        F.col("_subroot").alias("subroot"), F.col("_root").alias("root"), F.col("_path").alias("proof"),
    )


def proof_report(docs: DataFrame, tampered: Column, value: Column, column: str = "n_chars", id_column: str = "doc_id") -> DataFrame:
    """Check each row against the manifest of the table, where some rows were changed since.

    Where ``tampered`` holds, ``column`` is read as ``value`` when the row is checked. Returns the id
    column, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (of all siblings), ``folded_root``
    (from the row as it is now and the proof as it was) and ``verified``.
    """
    changed = leaf_digest([value if f == column else F.col(f) for f in FIELDS])
    told = manifest(docs, id_column, carry=[F.when(tampered, changed).alias("now")])
    folded = fold(F.coalesce("now", "leaf"), F.col("proof"))
    return told.select(
        id_column, "leaf", "subroot", "root", F.sha2(siblings(F.col("proof")), 256).alias("proof_sha256"), folded.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
