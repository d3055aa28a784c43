"""Folder trees and reorganisation proposals.

What needs each ancestor of a folder walks the tree level by level with plain joins; what needs
roots, depths, cycles or paths doubles its way up. Every step is checkpointed to the cluster's
shared folder, which cuts the lineage and lets the walk survive lost executors; the number
of steps is the depth of the tree or its logarithm, whatever the number of folders.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.operators.chunks import reject_rows
from corpusloom.operators.dealing import deal
from corpusloom.operators.mentions import mentioned_names
from corpusloom.session import ensure_checkpoint_dir


def closure(
    nodes: DataFrame, node: str = "folder_idx", parent: str = "parent_folder_idx", keys: tuple[str, ...] = (), partitions: int | None = None
) -> DataFrame:
    """Every (ancestor, descendant, depth) pair of a forest, each node with itself at depth 0.

    ``keys`` separate independent forests. A cycle is walked once: a step back to a node
    already on the path is not taken. A parent that is no node ends the path. ``partitions`` is
    the number that rows are dealt into by node.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    keys = list(keys)
    ids = deal(nodes.select(*keys, F.col(node).alias("_parent")), [*keys, "_parent"], partitions)
    links = nodes.where(F.col(parent).isNotNull()).select(*keys, F.col(node).alias("ancestor"), F.col(parent).alias("_parent"))
    links = deal(links, [*keys, "_parent"], partitions).join(ids, [*keys, "_parent"], "left_semi")
    links = deal(links, [*keys, "ancestor"], partitions).checkpoint()
    # The path holds one id per level.
    level = nodes.select(
        *keys,
        F.col(node).alias("ancestor"),
        F.col(node).alias("descendant"),
        F.lit(0).alias("depth"),
        F.array(F.col(node)).alias("_path"),
    )
    levels = []
    while True:
        levels.append(level.drop("_path"))
        up = deal(level, [*keys, "ancestor"], partitions).join(deal(links, [*keys, "ancestor"], partitions), [*keys, "ancestor"]).where(~F.array_contains("_path", F.col("_parent")))
        level = up.select(
            *keys,
            F.col("_parent").alias("ancestor"),
            "descendant",
            (F.col("depth") + 1).alias("depth"),
            F.array_append("_path", F.col("_parent")).alias("_path"),
        ).checkpoint()
        if level.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def climb(
    nodes: DataFrame,
    node: str,
    parent: str,
    keys: Sequence[str] = (),
    values: dict[str, Column] | None = None,
    merge: Callable[[Callable[[str], Column], Callable[[str], Column]], dict[str, Column]] | None = None,
) -> DataFrame:
    """Root, depth and collected values of each node of a forest, by doubling its way up.

    Every node holds a stretch of its way: the ancestor it has come to, and how far that is. In a round it
    takes over what that ancestor has, so a tree of depth d takes log2(d) rounds over one row for each
    node, instead of a row for each pair. Returns the keys, ``node``, ``root``, ``depth``,
    ``cyclic`` and the ``values``; a parent that is no node ends the way. Nodes whose way never ends
    are ``cyclic`` and have no root. ``nodes`` has one row for each key and node.

    ``values`` are those of a node alone. ``merge(lower, upper)`` joins two stretches, the second of which
    starts at the ancestor that the first has come to; both give a column for the name of
    a value, or for ``depth``, the length of the stretch.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    keys, values = list(keys), values or {}
    names = list(values)
    known = nodes.select(*keys, F.col(node).alias("_at"), F.lit(True).alias("_known"))
    own = nodes.select(*keys, F.col(node).alias("_node"), F.col(parent).alias("_at"), *[c.alias(n) for n, c in values.items()])
    own = own.join(known, [*keys, "_at"], "left")
    below = F.col("_known").isNotNull()
    state = own.select(
        *keys, "_node", F.when(below, F.col("_at")).otherwise(F.col("_node")).alias("_at"),
        below.cast("long").alias("depth"), (~below).alias("_done"), *names,
    ).checkpoint()
    left, covered = state.where("NOT _done").count(), 1
    while left:
        ahead = state.select(*keys, F.col("_node").alias("_at"), F.struct("_at", "depth", "_done", *names).alias("_up"))
        moved = state.where("NOT _done").join(ahead, [*keys, "_at"])
        joined = merge(F.col, lambda name: F.col(f"_up.{name}")) if merge else {}
        moved = moved.select(
            *keys, "_node", F.col("_up._at").alias("_at"), (F.col("depth") + F.col("_up.depth")).alias("depth"),
            F.col("_up._done").alias("_done"), *[joined[n].alias(n) for n in names],
        )
        state = state.where("_done").unionByName(moved).checkpoint()
        before, left, covered = left, state.where("NOT _done").count(), 2 * covered
        # Depths have no gaps: where no way ended in a round, those left are on cycles or lead to one.
        # Values are collected until each has the whole cycle.
        if left == before and (not names or covered > left):
            break
    return state.select(
        *keys, F.col("_node").alias(node), F.when(F.col("_done"), F.col("_at")).alias("root"), "depth", (~F.col("_done")).alias("cyclic"), *names
    )


def endless(nodes: DataFrame, node: str, parent: str, keys: Sequence[str] = ()) -> DataFrame:
    """Keys and ``node`` of the nodes whose way up never ends: those on a cycle or below one.

    Doubles as ``climb`` does, but keeps no stretch of a way that ends: a round has only the nodes whose way is still
    open, and what they ask for is among these, or their way ends too. ``nodes`` has one row for each key and node.
    """
    ensure_checkpoint_dir(nodes.sparkSession)
    keys = list(keys)
    way = nodes.select(*keys, F.col(node).alias("_node"), F.col(parent).alias("_at")).where(F.col("_at").isNotNull()).checkpoint()
    left, before = way.count(), None
    # As in ``climb``: where no way ended in a round, none of those left does.
    while left and left != before:
        ahead = way.select(*keys, F.col("_node").alias("_at"), F.col("_at").alias("_next"))
        way = way.join(ahead, [*keys, "_at"]).select(*keys, "_node", F.col("_next").alias("_at")).checkpoint()
        left, before = way.count(), left
    return way.select(*keys, F.col("_node").alias(node))


def folder_closure(folders: DataFrame) -> DataFrame:
    return closure(folders)


def folder_paths(folders: DataFrame, pairs: DataFrame) -> DataFrame:
    """Root-first path of each folder; the array is as long as the folder is deep."""
    names = folders.select(F.col("folder_idx").alias("ancestor"), "name")
    per = pairs.join(names, "ancestor").groupBy("descendant").agg(
        F.sort_array(F.collect_list(F.struct("depth", "ancestor", "name")), asc=False).alias("l")
    )
    return per.select(
        F.col("descendant").alias("folder_idx"),
        F.array_join(F.col("l.name"), "/").alias("path"),
        F.col("l.ancestor").alias("ancestors"),
        (F.size("l") - 1).alias("depth"),
    )


def invalid_moves(moves: DataFrame, pairs: DataFrame) -> DataFrame:
    """Moves (folder_idx, new_parent_idx) that would put a folder below itself."""
    down = pairs.select(F.col("ancestor").alias("folder_idx"), F.col("descendant").alias("new_parent_idx"))
    return moves.join(down, ["folder_idx", "new_parent_idx"], "left_semi")


def soft_delete_subtree(
    folders: DataFrame, files: DataFrame, pairs: DataFrame, roots: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Stamp the subtrees of ``roots`` and their live files with one millisecond timestamp."""
    stamp = F.date_trunc("MILLISECOND", now).cast("timestamp_ntz")
    gone = pairs.join(roots.select(F.col("folder_idx").alias("ancestor")), "ancestor", "left_semi")
    gone = gone.select(F.col("descendant").alias("folder_idx"), F.lit(True).alias("_gone")).distinct()
    new_folders = folders.join(gone, "folder_idx", "left").select(
        *[c for c in folders.columns if c != "deleted_at"],
        F.when(F.col("_gone"), stamp).otherwise(F.col("deleted_at")).alias("deleted_at"),
    )
    df = files.join(gone, "folder_idx", "left")
    hit = F.coalesce("_gone", F.lit(False)) & F.col("deleted_at").isNull()
    new_files = df.select(
        *[c for c in files.columns if c not in ("status", "deleted_at")],
        F.when(hit, F.lit("DELETED")).otherwise(F.col("status")).alias("status"),
        F.when(hit, stamp).otherwise(F.col("deleted_at")).alias("deleted_at"),
    )
    return new_folders, new_files


def restore_subtree(
    folders: DataFrame, files: DataFrame, chunks: DataFrame, pairs: DataFrame, roots: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Undo the deletion of ``roots``: folders, files, and the files to ingest again.

    Only rows stamped exactly like their restored root come back. A root whose parent is
    missing or still deleted becomes a top folder.
    """
    stamps = folders.join(roots.select("folder_idx"), "folder_idx", "left_semi").where(F.col("deleted_at").isNotNull())
    stamps = stamps.select(F.col("folder_idx").alias("ancestor"), F.col("deleted_at").alias("_stamp"))
    # One set of stamps per folder, no larger than the folder is deep.
    below = pairs.join(stamps, "ancestor").groupBy(F.col("descendant").alias("folder_idx")).agg(
        F.collect_set("_stamp").alias("_stamps")
    )
    matches = F.array_contains("_stamps", F.col("deleted_at"))
    back = folders.join(below, "folder_idx").where(matches).select("folder_idx", F.lit(True).alias("_back"))
    tops = stamps.select(F.col("ancestor").alias("folder_idx"), F.lit(True).alias("_root"))
    df = folders.join(back, "folder_idx", "left").join(tops, "folder_idx", "left")
    after = df.withColumn("deleted_at", F.when(F.col("_back").isNull(), F.col("deleted_at")))
    live = after.where(F.col("deleted_at").isNull()).select(
        F.col("folder_idx").alias("parent_folder_idx"), F.lit(True).alias("_parent_live")
    )
    after = after.join(live, "parent_folder_idx", "left")
    orphan = F.coalesce("_root", F.lit(False)) & F.col("_parent_live").isNull()
    new_folders = after.select(
        *[c for c in folders.columns if c != "parent_folder_idx"],
        F.when(~orphan, F.col("parent_folder_idx")).alias("parent_folder_idx"),
    )
    hit = files.join(below, "folder_idx", "left").withColumn("_hit", matches).drop("_stamps")
    new_files, again = _restored(hit, files.columns, chunks)
    return new_folders, new_files, again


def _restored(df: DataFrame, columns: list[str], chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    counts = chunks.groupBy("file_idx").agg(F.count("*").alias("_chunks"))
    df = df.join(counts, "file_idx", "left").fillna(0, ["_chunks"])
    hit = F.coalesce("_hit", F.lit(False))
    out = df.select(
        *[c for c in columns if c not in ("status", "deleted_at")],
        F.when(hit & (F.col("_chunks") > 0), F.lit("READY"))
        .when(hit, F.lit("UPLOADED"))
        .otherwise(F.col("status")).alias("status"),
        F.when(~hit, F.col("deleted_at")).alias("deleted_at"),
        (hit & (F.col("_chunks") == 0)).alias("_again"),
    )
    return out.drop("_again"), out.where("_again").select("file_idx", "uploads_idx")


def restore_files(files: DataFrame, folders: DataFrame, chunks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Restore single deleted files; one in a missing or deleted folder moves to the top."""
    asked = ids.select("file_idx", F.lit(True).alias("_asked")).distinct()
    live = folders.where(F.col("deleted_at").isNull()).select("folder_idx", F.lit(True).alias("_live"))
    df = files.join(asked, "file_idx", "left").join(live, "folder_idx", "left")
    df = df.withColumn("_hit", F.coalesce("_asked", F.lit(False)) & F.col("deleted_at").isNotNull())
    df = df.withColumn("folder_idx", F.when(~F.col("_hit") | F.col("_live"), F.col("folder_idx")))
    return _restored(df, files.columns, chunks)


def purge_order(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """Folders of the purged subtrees, children before their parents; depth is that below the highest root."""
    marked = folders.join(roots.select("folder_idx", F.lit(0).cast("long").alias("_mark")).distinct(), "folder_idx", "left")

    def merge(lower: Callable[[str], Column], upper: Callable[[str], Column]) -> dict[str, Column]:
        return {"_far": F.greatest(lower("_far"), lower("depth") + upper("_far"))}

    deep = climb(marked, "folder_idx", "parent_folder_idx", values={"_far": F.col("_mark")}, merge=merge)
    deep = deep.where(F.col("_far").isNotNull()).select("folder_idx", F.col("_far").cast("int").alias("depth"))
    return deep.orderBy(F.desc("depth"), "folder_idx")


def folder_tree_counts(folders: DataFrame, files: DataFrame, pairs: DataFrame) -> DataFrame:
    """Direct and total files per folder; files are counted before they meet the tree."""
    direct = files.where(F.col("folder_idx").isNotNull()).groupBy("folder_idx").agg(F.count("*").alias("n"))
    total = pairs.join(direct.withColumnRenamed("folder_idx", "descendant"), "descendant")
    total = total.groupBy("ancestor").agg(F.sum("n").alias("total_file_count"))
    df = folders.select("folder_idx").join(direct.withColumnRenamed("n", "file_count"), "folder_idx", "left")
    df = df.join(total.withColumnRenamed("ancestor", "folder_idx"), "folder_idx", "left")
    return df.fillna(0, ["file_count", "total_file_count"])


def best_matching_folder(docs: DataFrame, folders: DataFrame, pairs: DataFrame) -> DataFrame:
    """Folder of each document whose own and ancestor names its text mentions most.

    ``docs``: doc_id, users_idx, text. A mentioned leaf name scores 2, a mentioned
    ancestor 1; names need two characters; the first folder wins ties. The best folder is
    always one that is mentioned itself (any other scores one less than its nearest
    mentioned ancestor), so only mentioned folders are scored. Adds ``matched_names``, the
    mentioned names on the path from the root, and ``path``, all its names.

    Texts are read once, by an automaton over the names of their owner, and only what they
    mention is joined to the tree.
    """
    named = folders.select("users_idx", F.col("folder_idx").alias("descendant"), F.lower("name").alias("name"))
    named = named.where(F.length("name") >= 2)
    text = docs.select("doc_id", "users_idx", F.lower("text").alias("text")).where(F.length("text") >= 2)
    matched = mentioned_names(text, named).join(named, ["users_idx", "name"]).select("doc_id", "descendant")
    above = matched.join(pairs, "descendant")
    also = matched.select("doc_id", F.col("descendant").alias("ancestor"))
    scored = above.join(also, ["doc_id", "ancestor"], "left_semi").groupBy("doc_id", "descendant").agg(
        F.sum(F.when(F.col("depth") == 0, 2).otherwise(1)).alias("score")
    )
    best = scored.groupBy("doc_id").agg(
        F.min_by(F.struct(F.col("descendant").alias("folder_idx"), "score"), F.struct(-F.col("score"), "descendant")).alias("b")
    )
    best = best.select("doc_id", "b.*")
    # The path of the winner has one row per ancestor; its depth bounds the list.
    mentioned = also.withColumn("_mentioned", F.lit(True))
    on_path = best.join(pairs.withColumnRenamed("descendant", "folder_idx"), "folder_idx").join(
        folders.select(F.col("folder_idx").alias("ancestor"), "name"), "ancestor"
    )
    on_path = on_path.join(mentioned, ["doc_id", "ancestor"], "left")
    steps = F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "name", F.coalesce("_mentioned", F.lit(False)).alias("m"))))
    told = on_path.groupBy("doc_id", "folder_idx", "score").agg(steps.alias("_steps"))
    return told.select(
        "doc_id",
        "folder_idx",
        "score",
        F.transform(F.filter("_steps", lambda s: s["m"]), lambda s: s["name"]).alias("matched_names"),
        F.transform("_steps", lambda s: s["name"]).alias("path"),
    )


PROPOSAL = ("proposal_id",)


def _unique_proposed(proposed: DataFrame) -> DataFrame:
    """One row for each proposed folder; of one proposed twice, the parent that sorts first counts."""
    return proposed.where(F.col("temp_id").isNotNull()).groupBy(*PROPOSAL, "temp_id").agg(F.min("parent_temp_id").alias("parent_temp_id"))


def proposal_closure(proposed: DataFrame, partitions: int | None = None) -> DataFrame:
    """Closure of proposed folders, per proposal."""
    return closure(_unique_proposed(proposed), "temp_id", "parent_temp_id", PROPOSAL, partitions)


def proposal_depths(proposed: DataFrame) -> DataFrame:
    """Depth of each proposed folder below the top of its chain, and whether the chain is ``cyclic``."""
    return climb(_unique_proposed(proposed), "temp_id", "parent_temp_id", PROPOSAL)


def proposal_cycles(depths: DataFrame) -> DataFrame:
    """Proposed folders whose chain of parents never ends."""
    return depths.where("cyclic").select(*PROPOSAL, "temp_id")


def validate_proposal(
    proposed: DataFrame, mappings: DataFrame, owners: DataFrame, files: DataFrame, folders: DataFrame, partitions: int | None = None
) -> DataFrame:
    """Broken proposal rules as (proposal_id, rule, detail) rows; detail counts the rows.

    ``owners``: proposal_id, users_idx. ``partitions`` is the number that the first three tables are dealt
    into by proposal; rows that were looked up elsewhere are dealt back, and all counting stays in place.
    """
    p = [*PROPOSAL]

    def blank(c: str) -> Column:
        return F.coalesce(strip(F.col(c)), F.lit("")) == ""

    def given(c: str) -> Column:
        return F.col(c).isNotNull()

    mine = folders.where(F.col("deleted_at").isNull()).select(F.col("folder_idx").alias("_folder"), F.col("users_idx").alias("_owner"))
    live = files.where(F.col("deleted_at").isNull()).select(F.col("file_idx").alias("file_id"), F.col("users_idx").alias("_file_owner"))

    def owned(df: DataFrame, c: str) -> DataFrame:
        """Rows without a folder have nothing to look up, and would all meet in one task."""
        found = df.where(given(c)).join(owners, p).join(mine, F.col(c) == F.col("_folder"), "left")
        found = found.select(*df.columns, F.coalesce(F.col("_owner") == F.col("users_idx"), F.lit(False)).alias(f"{c}_ok"))
        return df.where(~given(c)).withColumn(f"{c}_ok", F.lit(True)).unionByName(deal(found, p, partitions))

    def rows(df: DataFrame, temp_id: str, **rules: Column) -> DataFrame:
        return df.select(*p, F.col(temp_id).alias("_id"), *[F.coalesce(c, F.lit(False)).cast("long").alias(n) for n, c in rules.items()])

    f = owned(proposed, "parent_folder_id")
    m = deal(owned(mappings, "target_folder_id").join(live, "file_id", "left"), p, partitions).join(owners, p)
    counted = [
        rows(proposed, "temp_id", _made=given("temp_id")),
        rows(
            f,
            "parent_temp_id",
            _under=given("parent_temp_id"),
            blank_temp_id=blank("temp_id"),
            blank_name=blank("name"),
            two_parents=given("parent_temp_id") & given("parent_folder_id"),
            foreign_parent_folder=~F.col("parent_folder_id_ok"),
        ),
        rows(
            m,
            "target_temp_id",
            _into=given("target_temp_id"),
            missing_file=~given("file_id"),
            foreign_file=given("file_id") & ~F.coalesce(F.col("_file_owner") == F.col("users_idx"), F.lit(False)),
            two_targets=given("target_folder_id") & given("target_temp_id"),
            foreign_target_folder=~F.col("target_folder_id_ok"),
            confidence_range=~F.coalesce(F.col("confidence").between(0, 1), F.lit(True)),
        ),
    ]
    counts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counted)
    # What a temporary id was made, and used, for meets in one row.
    sums = [c for c in counts.columns if c not in (*p, "_id")]
    ids = counts.groupBy(*p, "_id").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums])
    unknown = F.col("_made") == 0
    per_proposal = ids.groupBy(*p).agg(
        F.count_if(F.col("_made") > 1).alias("duplicate_temp_id"),
        F.sum(F.when(unknown, F.col("_under"))).alias("unknown_parent"),
        F.sum(F.when(unknown, F.col("_into"))).alias("unknown_target"),
        *[F.sum(c).alias(c) for c in sums if not c.startswith("_")],
    )
    twice = mappings.where(given("file_id")).groupBy(*p, "file_id").count().where("count > 1")
    files_twice = twice.groupBy(*p).agg(F.count("*").alias("duplicate_file"))
    cycles = endless(_unique_proposed(proposed), "temp_id", "parent_temp_id", PROPOSAL).groupBy(*p).agg(F.count("*").alias("cycle"))
    every = reduce(lambda a, b: a.join(b, p, "left"), [per_proposal, files_twice, deal(cycles, p, partitions)], owners)
    names = [c for c in every.columns if c not in (*p, "users_idx")]
    return reject_rows(every, p, [(n, F.col(n) > 0, F.col(n)) for n in names])


def needed_new_folders(proposed: DataFrame, mappings: DataFrame, pairs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Proposed folders that kept mappings use, with all their ancestors.

    ``partitions`` is the number that rows are dealt into by folder.
    """
    below, own = [*PROPOSAL, "descendant"], [*PROPOSAL, "temp_id"]
    used = mappings.where(F.col("target_temp_id").isNotNull()).select(*PROPOSAL, F.col("target_temp_id").alias("descendant"))
    used = deal(used, below, partitions).distinct()
    needed = deal(pairs.select(*below, "ancestor"), below, partitions).join(used, below, "left_semi")
    needed = deal(needed.select(*PROPOSAL, F.col("ancestor").alias("temp_id")), own, partitions).distinct()
    return deal(proposed, own, partitions).join(needed, own, "left_semi")


def apply_mappings(files: DataFrame, mappings: DataFrame, created: DataFrame, max_name: int = 200) -> DataFrame:
    """Files after a proposal moved and renamed them.

    ``created``: proposal_id, temp_id, folder_idx of the folders made. A blank new name
    keeps the old one, a long one is cut.
    """
    real = created.select(*PROPOSAL, F.col("temp_id").alias("target_temp_id"), F.col("folder_idx").alias("_real"))
    m = mappings.join(real, [*PROPOSAL, "target_temp_id"], "left")
    name = F.left(F.btrim("new_name", F.lit("".join(map(chr, range(0x21))))), F.lit(max_name))
    m = m.select(
        F.col("file_id").alias("file_idx"),
        F.lit(True).alias("_moved"),
        F.when(F.col("target_temp_id").isNotNull(), F.col("_real")).otherwise(F.col("target_folder_id")).alias("_folder"),
        F.when(strip(name) != "", name).alias("_name"),
    )
    return files.join(m, "file_idx", "left").select(
        *[c for c in files.columns if c not in ("folder_idx", "name")],
        F.when(F.col("_moved"), F.col("_folder")).otherwise(F.col("folder_idx")).alias("folder_idx"),
        F.coalesce("_name", "name").alias("name"),
    )


def creation_waves(proposed: DataFrame) -> DataFrame:
    """Wave in which each proposed folder can be made: its number of proposed ancestors. Cyclic ones never can."""
    return proposal_depths(proposed).where("NOT cyclic").select(*PROPOSAL, "temp_id", F.col("depth").cast("int").alias("wave"))


def filter_proposal(mappings: DataFrame, targets: DataFrame, allow_rename: bool) -> DataFrame:
    """Mappings for the target files only; new names are dropped unless renames are allowed."""
    kept = mappings.join(targets.select(*PROPOSAL, "file_id").distinct(), [*PROPOSAL, "file_id"], "left_semi")
    return kept if allow_rename else kept.withColumn("new_name", F.lit(None).cast("string"))


def shape_tree_paths(shapes: DataFrame, slide: list[str]) -> DataFrame:
    """Dotted path and depth of nested shapes; ordinals number siblings from 1.

    ``shapes``: the slide columns, shape_id, parent_id, ordinal.
    """

    def merge(lower: Callable[[str], Column], upper: Callable[[str], Column]) -> dict[str, Column]:
        return {"shape_path": F.concat(upper("shape_path"), F.lit("."), lower("shape_path"))}

    ways = climb(shapes, "shape_id", "parent_id", slide, {"shape_path": F.col("ordinal").cast("string")}, merge)
    return ways.select(*slide, "shape_id", "shape_path", (F.col("depth") + 1).cast("int").alias("shape_depth"))
