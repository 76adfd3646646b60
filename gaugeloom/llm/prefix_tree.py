"""Conversation prefix trie: which conversations begin with the same turns, and what sharing them saves.

A node is a distinct sequence of first turns (role, text); conversations that begin with it are its members, the smallest of them owns it.
Who owns a node owns its deeper ones, too, as long as its own conversation goes on: so each conversation owns a chain, from a first owned depth to its end, and
hangs by the node above it in another's chain.

* Turns get places: rows are dealt by ranges of conversation and turn, counted per part, and numbered from the parts before.  So one conversation may hold any
  share of all turns.
* A prefix's digest is the exclusive or of 128-bit hashes of its turns (SHA-256) with their depths: running within chunks of STEP depths, carried over
  from chunk to chunk.
* Minima: the smallest conversation of each digest that several have.  A conversation's first owned depth is found by joins of all
  conversations' probes with the minima at once: ends of chunks first, then halves of what is left of the chunk, so that no more
  than log2(STEP) rounds follow, and no more than twice the digests travel.  The last owner met that is another's is what the chain hangs by.
* Chains are aggregated bottom-up: sums over subtrees by doubling (each round a chain gives its sum to an ancestor twice as far), then
  sums from a chain's end to each node, again by chunks.
* Ids that end at a node are hashed as a stream, in pieces that are put together in the parts of a range partitioning.

Turns are ordered by turn, null first; those with the same number by role, then by a hash of the turn.  Null role or text is empty.  Rows with a null
conversation id are left out.  An empty table has no nodes.  Other columns are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import keep, scratch, table

#: Depths of a chunk, and ids of a piece of a node's list.
STEP, PIECE = 64, 4096
#: Characters between words; conversations are rebuilt from one of each EVERY, by up to BRANCHES - 1 of its turns.
WORD = r"[^\x20\x09-\x0D]+"
EVERY, BRANCHES = 20, 4
COLUMNS = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def digested(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Written tables: turns (conv_id, part, place from 1, t1, t2, words), and parts (conv_id, part, rows)."""
    said = F.coalesce(F.col(text).cast("string"), F.lit(""))
    who = F.coalesce(F.col(role).cast("string"), F.lit(""))
    mark = F.sha2(F.concat(F.char_length(who).cast("string"), F.lit(":"), who, said), 256)
    rows = conversations.where(F.col(conv).isNotNull()).select(F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).alias("turn"), who.alias("role"), F.xxhash64(mark).alias("t1"), F.xxhash64(F.lit(1), mark).alias("t2"), F.regexp_count(said, F.lit(WORD)).cast("bigint").alias("words"))
    order = ("turn", "role", "t1", "t2")
    dealt = keep(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()), "dealt-turns")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = keep(dealt.groupBy("conv_id", "part").agg(F.count("*").alias("rows")).withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))), "parts")
    place = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    turns = dealt.join(parts, ["conv_id", "part"]).select("conv_id", "part", (F.col("before") + place).alias("place"), "t1", "t2", "words")
    return keep(turns, "turns"), parts.select("conv_id", "part", "rows")


def rebuilt(turns: DataFrame, parts: DataFrame, base: Column, borrowed: Column) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first `borrowed` turns of conversation `base` (columns of conv_id) for as many of their own:
    turns (conv_id, d, t1, t2, words), and conversations (conv_id, length)."""
    whole = parts.groupBy("conv_id").agg(F.sum("rows").alias("own")).withColumns({"base": base, "borrowed": borrowed.cast("bigint")})
    wanted = whole.groupBy("base").agg(F.max("borrowed").alias("most")).withColumnRenamed("base", "conv_id")
    heads = turns.join(wanted, "conv_id").where("place <= most").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "words"))).alias("head"))
    none = F.array().cast("array<struct<place:bigint,t1:bigint,t2:bigint,words:bigint>>")
    joined = whole.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("head", F.slice(F.coalesce("head", none), F.lit(1), F.col("borrowed").cast("int")))
    known = keep(joined.select("conv_id", "own", "borrowed", "head"), "rebuilt")
    shifts = parts.join(known.select("conv_id", "borrowed", (F.size("head") - F.col("borrowed")).alias("shift")), "conv_id").select("conv_id", "part", "borrowed", "shift")
    own = turns.join(shifts, ["conv_id", "part"]).where("place > borrowed").select("conv_id", (F.col("place") + F.col("shift")).alias("d"), "t1", "t2", "words")
    other = known.select("conv_id", F.inline("head")).withColumnRenamed("place", "d")
    return own.unionByName(other), known.select("conv_id", (F.size("head") + F.greatest(F.col("own") - F.col("borrowed"), F.lit(0))).alias("length"))


def _chunks(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, steps): prefix digests of up to STEP depths."""
    hashed = turns.select("conv_id", F.floor((F.col("d") - 1) / STEP).alias("chunk"), "d", "words", F.xxhash64("d", "t1", "t2").alias("x1"), F.xxhash64(F.lit(7), "d", "t1", "t2").alias("x2"))
    running = Window.partitionBy("conv_id", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    local = hashed.withColumns({x: F.bit_xor(x).over(running) for x in ("x1", "x2")})
    chunks = keep(local.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("d", "x1", "x2", "words"))).alias("steps")), "local-digests")
    earlier = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    last = F.element_at("steps", -1)
    carried = chunks.select("conv_id", "chunk", last["x1"].alias("c1"), last["x2"].alias("c2")).withColumns({c: F.bit_xor(c).over(earlier) for c in ("c1", "c2")}).where("chunk > 0")
    whole = chunks.join(carried, ["conv_id", "chunk"], "left")
    joined = F.transform("steps", lambda s: F.struct(s["d"].alias("d"), s["x1"].bitwiseXOR(F.coalesce("c1", F.lit(0))).alias("p1"), s["x2"].bitwiseXOR(F.coalesce("c2", F.lit(0))).alias("p2"), s["words"].alias("words")))
    return keep(whole.select("conv_id", "chunk", joined.alias("steps")), "digests")


def _owner(probes: DataFrame, minima: DataFrame) -> DataFrame:
    """probes with the owner of the prefix in their column `step`."""
    flat = probes.withColumns({c: F.col("step")[c] for c in ("d", "p1", "p2")})
    return flat.join(minima, ["d", "p1", "p2"], "left").withColumn("owner", F.coalesce("owner", "conv_id")).drop("p1", "p2")


def first_owned(chunks: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, length, parent, at): the deepest prefix that isn't the conversation's own, 0 and null if there is none but the root."""
    ends = _owner(chunks.withColumn("step", F.element_at("steps", -1)), minima)
    own = F.col("owner") == F.col("conv_id")
    found = ends.groupBy("conv_id").agg(
        F.max("d").alias("length"), F.max_by("owner", F.when(~own, F.col("chunk"))).alias("parent"), F.coalesce(F.max(F.when(~own, F.col("d"))), F.lit(0)).alias("at"), F.min_by("steps", F.when(own, F.col("chunk"))).alias("left")
    )
    left = F.coalesce(F.size("left") - 1, F.lit(0))
    state = keep(found.withColumn("left", F.when(left > 0, F.slice("left", F.lit(1), left))), "search")
    done = state.where("left IS NULL").drop("left")
    while not (state := state.where("left IS NOT NULL")).isEmpty():
        half = F.ceil(F.size("left") / 2).cast("int")
        met = _owner(state.withColumns({"half": half, "step": F.element_at("left", half)}), minima)
        rest = F.when(own, F.slice("left", F.lit(1), F.col("half") - 1)).otherwise(F.slice("left", F.col("half") + 1, F.size("left")))
        moved = met.select("conv_id", "length", F.when(own, F.col("parent")).otherwise(F.col("owner")).alias("parent"), F.when(own, F.col("at")).otherwise(F.col("d")).alias("at"), rest.alias("left"))
        state = keep(moved.withColumn("left", F.when(F.size("left") > 0, F.col("left"))), "search")
        done = done.unionByName(state.where("left IS NULL").drop("left"))
    return done


def _rolled_up(chains: DataFrame, *values: str) -> DataFrame:
    """chains (conv_id, parent, values) with sums over each chain's subtree, written.  Rounds grow with the logarithm of the deepest nesting."""
    now = keep(chains.select("conv_id", F.col("parent").alias("up"), *values), "chains")
    while not (below := now.where("up IS NOT NULL")).isEmpty():
        given = below.groupBy("up").agg(*[F.sum(v).alias(f"more_{v}") for v in values]).withColumnRenamed("up", "conv_id")
        further = now.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        summed = now.join(given, "conv_id", "left").select("conv_id", "up", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values])
        now = keep(summed.join(further, "up", "left").select("conv_id", F.col("next").alias("up"), *values), "chains")
    return now.drop("up")


def _to_the_end(nodes: DataFrame, *values: str) -> DataFrame:
    """nodes with sums of values from each down to its chain's end."""
    on = Window.partitionBy("conv_id", "chunk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy("conv_id").orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)
    totals = nodes.groupBy("conv_id", "chunk").agg(*[F.sum(v).alias(f"later_{v}") for v in values]).withColumns({f"later_{v}": F.sum(f"later_{v}").over(later) for v in values})
    local = nodes.withColumns({v: F.sum(v).over(on) for v in values}).join(totals, ["conv_id", "chunk"])
    return local.withColumns({v: F.col(v) + F.coalesce(f"later_{v}", F.lit(0)) for v in values}).drop(*[f"later_{v}" for v in values])


def _pieces(batches):
    """Lists of ids, of rows sorted by node and id."""
    for batch in batches:
        node, depth, ids = (batch.column(c).to_numpy() for c in ("node", "depth", "conv_id"))
        begin = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (depth[1:] != depth[:-1]))) if len(node) else np.empty(0, int)
        edges = np.append(begin, len(node))
        cuts = np.concatenate([[0], *[np.arange(a, b, PIECE) for a, b in zip(edges[:-1], edges[1:], strict=True)]]).astype(int)[1:]
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, np.append(cuts[1:], len(node)), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(node[cuts]), pa.array(depth[cuts]), pa.array(ids[cuts]), pa.array(texts, pa.string())], ["node", "depth", "first", "piece"])


def _hashed(batches):
    """SHA-256 of each node's pieces, sorted by node and first id, joined by commas."""
    at, sha = None, None
    def flush():
        return pa.RecordBatch.from_arrays([pa.array([n for n, _, _ in out], pa.int64()), pa.array([d for _, d, _ in out], pa.int64()), pa.array([s for *_, s in out], pa.string())], ["node", "depth", "sha"])

    for batch in batches:
        out = []
        for node, depth, piece in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "piece")), strict=True):
            if at == (node, depth):
                sha.update(b",")
            else:
                if at:
                    out.append((*at, sha.hexdigest()))
                at, sha = (node, depth), hashlib.sha256()
            sha.update(piece.encode())
        yield flush()
    out = [(*at, sha.hexdigest())] if at else []
    yield flush()


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(node, depth, sha): of the ids of the conversations (node, depth, conv_id) that end at each node."""
    pieces = ends.repartitionByRange("node", "depth", "conv_id").sortWithinPartitions("node", "depth", "conv_id").mapInArrow(_pieces, "node bigint, depth bigint, first bigint, piece string")
    return pieces.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(_hashed, "node bigint, depth bigint, sha string")


def tree(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of turns (conv_id, d from 1 without gaps, t1, t2, words) of conversations (conv_id, length): one row each,
    told by the smallest member and the depth, with parent, members, children, leaves, saved tokens and the hash of the ids that end there."""
    with scratch(turns.sparkSession) as hold:
        return hold(_tree(turns, conversations), "prefix-tree")


def _tree(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    chunks = _chunks(turns)
    minima = keep(chunks.select("conv_id", F.inline("steps")).groupBy("d", "p1", "p2").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"), "minima")
    silent = conversations.where("length = 0").select("conv_id", F.lit(0).cast("bigint").alias("length"), F.lit(None).cast("bigint").alias("parent"), F.lit(0).cast("bigint").alias("at"))
    known = keep(first_owned(chunks, minima).unionByName(silent), "owned")
    root = known.agg(F.min("conv_id")).first()[0]
    if root is None:
        return turns.sparkSession.createDataFrame([], COLUMNS)
    is_root = F.col("conv_id") == root
    known = known.withColumns({"parent": F.when(~is_root, F.coalesce("parent", F.lit(root))), "at": F.when(is_root, F.lit(-1)).otherwise(F.col("at"))})
    chains = known.where("at < length")
    ends = known.select(F.when(F.col("at") < F.col("length"), F.col("conv_id")).otherwise(F.col("parent")).alias("node"), F.col("length").alias("depth"), "conv_id")

    hung = lambda rows, *values: rows.where("parent IS NOT NULL").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(F.count("*").alias("hanging"), *[F.sum(v).alias(f"hung_{v}") for v in values])
    ending = ends.groupBy("node").agg(F.count("*").alias("members")).withColumnRenamed("node", "conv_id")
    last = chains.join(hung(chains).withColumnRenamed("depth", "length"), ["conv_id", "length"], "left")
    own = last.join(ending, "conv_id", "left").select("conv_id", "parent", F.coalesce("members", F.lit(0)).alias("members"), F.col("hanging").isNull().cast("bigint").alias("leaves"))
    sums = _rolled_up(own, "members", "leaves")
    attached = hung(chains.join(sums, "conv_id"), "members", "leaves")
    ended = ends.groupBy(F.col("node").alias("conv_id"), "depth").agg(F.count("*").alias("ended"))

    steps = chunks.join(chains, "conv_id").select("conv_id", "chunk", "length", "parent", "at", F.inline("steps")).where("d > at").select("conv_id", "chunk", "length", "parent", "at", F.col("d").alias("depth"), "words")
    top = chains.where(is_root).select("conv_id", F.lit(0).cast("bigint").alias("chunk"), "length", "parent", "at", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("words"))
    nodes = steps.unionByName(top).join(ended, ["conv_id", "depth"], "left").join(attached, ["conv_id", "depth"], "left").na.fill(0, ["ended", "hanging", "hung_members", "hung_leaves"])
    leaf = ((F.col("depth") == F.col("length")) & (F.col("hanging") == 0)).cast("bigint")
    nodes = nodes.withColumns({"n_convs": F.col("ended") + F.col("hung_members"), "n_leaves": leaf + F.col("hung_leaves"), "n_children": F.col("hanging") + (F.col("depth") < F.col("length")).cast("bigint")})
    counted = keep(_to_the_end(nodes, "n_convs", "n_leaves").withColumn("saved", (F.col("n_convs") - 1) * F.col("words")), "counted-nodes")

    saved = _rolled_up(counted.groupBy("conv_id").agg(F.first("parent").alias("parent"), F.sum("saved").alias("saved")), "saved")
    given = hung(chains.join(saved, "conv_id"), "saved").drop("hanging")
    summed = _to_the_end(counted.join(given, ["conv_id", "depth"], "left").withColumn("saved_tokens", F.col("saved") + F.coalesce("hung_saved", F.lit(0))), "saved_tokens")
    hashes = ends_hashed(ends).withColumnRenamed("node", "conv_id")
    out = summed.join(hashes, ["conv_id", "depth"], "left")
    above = F.when(F.col("depth") == F.col("at") + 1, F.col("parent")).otherwise(F.col("conv_id"))
    return out.select("conv_id", "depth", above.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op12_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as hold:
        turns, parts = digested(table(spark, sf_dir, "conversations"))
        c = F.col("conv_id")
        return hold(_tree(*rebuilt(turns, parts, c - c % EVERY, F.crc32(c.cast("string")) % BRANCHES)), "prefix-tree")


QUERIES = {"op12_prefix_tree": op12_prefix_tree}
