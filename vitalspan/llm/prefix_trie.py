"""Prefix trie of rebuilt conversations, aggregated by ROLLUP over positional turn columns.

A turn is named by a digest of role and text together with the bytes of its text.  A
conversation is laid out in rows of ``width`` positional columns ``t1 .. tN``; turns beyond
them stand in further rows (column blocks), keyed by the prior block's node, that is by the
name of all turns before the block.  One ``GROUP BY block, node, ROLLUP (t1, .., tN)``
therefore aggregates the prefixes of every length together, and ``grouping_id()`` tells how
many turns of the block a group holds.  Names of nodes are four running sums of 32-bit hashes
of (turn, position): sums can be carried over block by block, so a conversation is never held
as one list.

What a node's subtree holds is a sum over its members as well, since every node belongs to
its smallest member and a conversation owns an unbroken end of its own path:

* leaves: each is counted by the conversation that owns it;
* saved bytes: a member shares the bytes before its first own node with smaller ones, and
  what lies before the node counts for every member but the smallest.

So a second ROLLUP, over the same rows with two more numbers per conversation, ends the work;
nothing is summed up the tree level by level.

Defined cases: rows without conv_id take no part; turns with the same number are ordered by
their digest, repeated rows are turns of their own; an empty table has no nodes.  Other columns
are ignored.  The digests of ending members are fed piece by piece, ids in ascending order, so
no list of a node's members is held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspan.llm.common import written
from vitalspan.operators.cells import position_in_group, running_totals

WIDTH = 8  # positional columns of a block
HEAD = 8  # most turns that are taken over from the base conversation
FAMILY = 5
CELL_TURNS = 64  # turn numbers that are ranked together
CELL_BLOCKS = 1024
PIECE_BITS = 16  # ending members within 2**16 ids make one piece
LANES = (1, 2, 3, 4)
EMPTY = hashlib.sha256(b"").hexdigest()


# --- turns ------------------------------------------------------------------------------


def turn_name(role: Column, text: Column) -> Column:
    """16 bytes of digest of (role, text) and 4 bytes with the size of the text in UTF-8."""
    size = F.octet_length(text)
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    return F.unhex(F.concat(digest, F.lpad(F.hex(size.cast("long")), 8, "0")))


def turn_bytes(name: str) -> str:
    """SQL of the size in a turn's name; null turns have none."""
    return f"coalesce(CAST(conv(hex(substring({name}, 17, 4)), 16, 10) AS BIGINT), 0L)"


def lane(seed: int, name: str, position: str) -> str:
    """SQL of one of the hashes whose running sums name a node; null turns add nothing."""
    return f"if({name} IS NULL, 0L, xxhash64({seed}, {name}, CAST({position} AS BIGINT)) & 4294967295L)"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv, pos (from 1 by turn, null first), name."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), turn_name(role, text).alias("name")
    )
    cell = F.coalesce(F.floor(F.col("turn") / CELL_TURNS), F.lit(-(2**62)))
    order = [F.col("turn").asc_nulls_first(), F.col("name")]
    return position_in_group(rows, ["conv"], cell, order, "pos").select("conv", "pos", "name")


def head_turns(conv: Column) -> Column:
    """How many turns a conversation takes over from the first one of its family."""
    return (F.crc32(conv.cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, n) of every conversation, and its rebuilt turns conv, n, pos, name."""
    base = F.col("conv") - F.col("conv") % FAMILY
    own = turns.groupBy("conv").agg(F.count("*").alias("own"))
    own = own.select("conv", "own", base.alias("base"), head_turns(F.col("conv")).alias("h"))
    heads = (
        turns.where((F.col("conv") % FAMILY == 0) & (F.col("pos") <= HEAD))
        .groupBy("conv")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("head"))
        .select(F.col("conv").alias("base"), F.col("head.name").alias("head"))
    )
    taken = F.slice(F.coalesce("head", F.array().cast("array<binary>")), F.lit(1), F.col("h"))
    convs = own.join(heads, "base", "left").withColumn("head", taken)
    added = F.size("head")
    convs = written(convs.select("conv", "h", "head", (added + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    first = convs.select("conv", "n", F.posexplode("head").alias("pos", "name"))
    first = first.select("conv", "n", (F.col("pos") + 1).cast("long").alias("pos"), "name")
    rest = turns.where(F.col("pos") > head_turns(F.col("conv"))).join(
        convs.select("conv", "n", (F.size("head") - F.col("h")).alias("shift")), "conv"
    )
    rest = rest.select("conv", "n", (F.col("pos") + F.col("shift")).alias("pos"), "name")
    return convs.select("conv", "n"), first.union(rest)


# --- column blocks ----------------------------------------------------------------------


def column_blocks(convs: DataFrame, turns: DataFrame, width: int) -> DataFrame:
    """conv, n, block, p1..p4 and pb (name and bytes of all turns before the block), t1..tN."""
    sums = {f"p{i}": F.col(f"s{i}") for i in LANES} | {"pb": F.col("sb")}
    rows = turns.withColumns(
        {"block": F.expr(f"(pos - 1) div {width}")}
        | {f"l{i}": F.expr(lane(i, "name", "pos")) for i in LANES}
        | {"lb": F.expr(turn_bytes("name"))}
    )
    packed = rows.groupBy("conv", "n", "block").agg(
        F.array_sort(F.collect_list(F.struct("pos", "name"))).alias("turns"),
        *[F.sum(f"l{i}").alias(f"s{i}") for i in (*LANES, "b")],
    )
    names = F.col("turns.name")
    packed = packed.select(
        "conv", "n", "block", *[f"s{i}" for i in (*LANES, "b")], *[F.get(names, F.lit(j)).alias(f"t{j + 1}") for j in range(width)]
    )
    packed = written(packed)
    columns = ["conv", "n", "block", *sums, *[f"t{j + 1}" for j in range(width)]]
    short = packed.where(F.col("n") <= width).withColumns({name: F.lit(0).cast("long") for name in sums})
    cell = F.expr(f"block div {CELL_BLOCKS}")
    long = running_totals(packed.where(F.col("n") > width), ["conv"], cell, [F.col("block")], sums)
    long = long.withColumns({name: F.col(name) - c for name, c in sums.items()})
    bare = convs.where("n = 0").select(
        "conv", "n", F.lit(0).cast("long").alias("block"), *[F.lit(0).cast("long").alias(c) for c in sums],
        *[F.lit(None).cast("binary").alias(f"t{j + 1}") for j in range(width)],
    )
    return short.select(columns).union(long.select(columns)).union(bare.select(columns))


def rolled_up(blocks: DataFrame, width: int, aggregates: str) -> DataFrame:
    """Every node with its aggregates, depth, name (k1..k4), parent's name (q1..q4) and bytes before."""
    names = [f"t{j + 1}" for j in range(width)]
    keys = ["block", *[f"p{i}" for i in LANES], "pb"]
    found = blocks.sparkSession.sql(
        f"SELECT {', '.join(keys + names)}, grouping_id() AS g, {aggregates} FROM {{blocks}} "
        f"GROUP BY {', '.join(keys)}, ROLLUP ({', '.join(names)})",
        blocks=blocks,
    )
    turns = f"array({', '.join(names)})"
    found = found.selectExpr("*", f"{width} - bit_count(g) AS level", f"{turns} AS turns").where(
        "level = size(filter(turns, t -> t IS NOT NULL)) AND (level > 0 OR block = 0)"
    )
    kept = [c for c in found.columns if c not in (*keys, *names, "g", "level", "turns")]
    found = found.selectExpr(
        *kept, f"block * {width} + level AS depth", "get(turns, level - 1) AS last",
        *[f"{name_of(i, width)} AS k{i}" for i in LANES], f"{bytes_of(width)} AS through",
    )
    return found.selectExpr(
        *kept, "depth", *[f"k{i}" for i in LANES], *[f"k{i} - {lane(i, 'last', 'depth')} AS q{i}" for i in LANES],
        f"through - {turn_bytes('last')} AS before",
    )


def name_of(i: int, width: int) -> str:
    """SQL of the running sum up to the last turn of the row."""
    turns = ", ".join(f"t{j + 1}" for j in range(width))
    own = f"transform(array({turns}), (t, j) -> {lane(i, 't', f'block * {width} + j + 1')})"
    return f"p{i} + aggregate({own}, 0L, (a, x) -> a + x)"


def bytes_of(width: int) -> str:
    """SQL of the bytes of all turns up to the last one of the row."""
    turns = ", ".join(f"t{j + 1}" for j in range(width))
    return f"pb + aggregate(transform(array({turns}), t -> {turn_bytes('t')}), 0L, (a, x) -> a + x)"


# --- the trie ---------------------------------------------------------------------------


def prefix_trie(conversations: DataFrame, *, width: int = WIDTH) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    convs, turns = rebuilt(written(ordered_turns(conversations)))
    blocks = written(column_blocks(convs, turns, width))
    names, above = [f"k{i}" for i in LANES], [f"q{i}" for i in LANES]
    found = rolled_up(blocks, width, "min(conv) AS conv_id, max(n) AS longest")
    found = written(found.select("depth", *names, *above, "conv_id", "longest", "before"))

    upper = found.select(
        (F.col("depth") + 1).alias("depth"), *[F.col(k).alias(q) for k, q in zip(names, above, strict=True)],
        F.col("conv_id").alias("parent_conv_id"),
    )
    nodes = found.where("depth > 0").join(upper, ["depth", *above])
    root = found.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    columns = ["conv_id", "depth", "parent_conv_id", "longest", "before", *names]
    nodes = written(nodes.select(columns).union(root.select(columns)))

    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    children = children.agg(F.count("*").alias("n_children"))

    last = blocks.where(f"block = (greatest(n, 1) - 1) div {width}").selectExpr(
        "conv", "CAST(n AS BIGINT) AS depth", *[f"{name_of(i, width)} AS k{i}" for i in LANES], f"{bytes_of(width)} AS total"
    )
    owned = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.min("before").alias("shared"), F.max((F.col("longest") == F.col("depth")).cast("long")).alias("leaf")
    )
    share = last.join(owned, "conv", "left").select(
        "conv", F.coalesce("shared", "total").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    sums = rolled_up(
        blocks.join(share, "conv"), width,
        "min(conv) AS conv_id, count(*) AS n_convs, sum(leaf) AS n_leaves, sum(shared) AS all_shared, min_by(shared, conv) AS first_shared",
    )
    saved = F.col("all_shared") - F.col("first_shared") - F.col("before") * (F.col("n_convs") - 1)
    sums = sums.select("conv_id", "depth", "n_convs", "n_leaves", saved.alias("saved_tokens"))

    ends = ending_digests(last, nodes)
    joined = nodes.select("conv_id", "depth", "parent_conv_id").join(sums, ["conv_id", "depth"])
    joined = joined.join(children, ["conv_id", "depth"], "left").join(ends, ["conv_id", "depth"], "left")
    return joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


def ending_digests(last: DataFrame, nodes: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the nodes at which conversations end."""
    names = [f"k{i}" for i in LANES]
    ids = F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string"))
    pieces = last.groupBy("depth", *names, F.shiftright("conv", PIECE_BITS).alias("piece")).agg(F.array_join(ids, ",").alias("ids"))
    placed = pieces.join(nodes.select("depth", *names, "conv_id"), ["depth", *names]).select("conv_id", "depth", "piece", "ids")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                key = row["conv_id"], row["depth"]
                if key != now:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(row["ids"].encode())
            yield _digests(done)
        if now is not None:
            yield _digests([(*now, state.hexdigest())])

    dealt = placed.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "piece")
    return dealt.mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def _digests(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    conv, depth, digest = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_pydict(
        {"conv_id": pa.array(conv, pa.int64()), "depth": pa.array(depth, pa.int64()), "ends_sha256": pa.array(digest, pa.string())}
    )
