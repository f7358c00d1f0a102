"""Prefixes that conversations share: a z-fast trie whose compacted nodes are found by a hash of the prefix at their
two-fattest depth, filled in batches, and expanded to one row for each distinct prefix."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garderobe.llm.common import Stash, word_count

#: Turns of a conversation that one window goes through; a longer one is cut into such blocks and shifted by their sums.
SPAN = 256
#: Conversations in one piece of a list that is hashed.
LISTED = 10_000
BASE, KEPT = 20, 4
NOTHING = hashlib.sha256(b"").hexdigest()
STEP = ["sum0", "sum1", "sum2", "sum3", "words"]


def root() -> Column:
    return F.unhex(F.md5(F.lit("root").cast("binary")))


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, mark, words): the turns of each conversation counted from 1, nulls of ``turn`` first, then by
    turn, role and text; ``mark`` is an MD5 of role and text. Rows without conv_id belong to no conversation."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    block = F.coalesce(F.floor(F.col("turn").cast("double") / SPAN), F.lit(-(1 << 62))).cast("long")
    own = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), block.alias("block"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    mark = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    rows = own.select("conv_id", "block", F.row_number().over(inside).cast("long").alias("place"), mark.alias("mark"), word_count(F.col("text")).alias("words"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("conv_id", "block").agg(F.count("*").alias("n"))
    shifts = sizes.select("conv_id", "block", F.sum("n").over(earlier).alias("shift")).where("shift > 0")
    rows = rows.join(shifts, ["conv_id", "block"], "left")
    return rows.select("conv_id", (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"), "mark", "words")


def rebuilt(numbered: DataFrame, base: int = BASE, kept: int = KEPT) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, mark, words) of conversations that begin with the first h turns of conversation c - c % base and
    go on with their own turns after the h-th, h = crc32(c) % kept; and all their conv_ids, those without turns too."""
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % kept).alias("head")
    sizes = numbered.groupBy("conv_id").agg(F.count("*").alias("n"))
    convs = sizes.select("conv_id", head, (F.col("conv_id") - F.col("conv_id") % base).alias("base_id"))
    given = sizes.where(F.col("conv_id") % base == 0).select(F.col("conv_id").alias("base_id"), F.col("n").alias("base_n"))
    convs = convs.join(given, "base_id", "left").withColumn("taken", F.least("head", F.coalesce("base_n", F.lit(0))))
    first = numbered.where((F.col("conv_id") % base == 0) & (F.col("place") < kept)).withColumnRenamed("conv_id", "base_id")
    begun = convs.select("conv_id", "base_id", "head").join(first, "base_id").where("place <= head").select("conv_id", F.col("place").alias("depth"), "mark", "words")
    own = numbered.join(convs.select("conv_id", "head", "taken"), "conv_id").where("place > head")
    own = own.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "mark", "words")
    return begun.unionByName(own), convs.select("conv_id")


def prefix_prints(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, print, words): a 128-bit print of the first ``depth`` turns and the words in them. The print is
    made of running sums of hashes of (depth, turn), so blocks of a long conversation are summed on their own."""
    halves = []
    for i, h in enumerate((F.xxhash64("depth", "mark"), F.xxhash64("mark", "depth"))):
        halves += [h.bitwiseAND(F.lit(0xFFFFFFFF)).alias(f"sum{2 * i}"), F.shiftrightunsigned(h, 32).alias(f"sum{2 * i + 1}")]
    rows = turns.select("conv_id", "depth", F.expr(f"depth div {SPAN}").alias("block"), *halves, "words")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv_id", "block").agg(*[F.sum(c).alias(c) for c in STEP])
    shifts = totals.select("conv_id", "block", *[F.sum(c).over(earlier).alias(f"{c}_before") for c in STEP]).where("words_before is not null")
    run = rows.select("conv_id", "depth", "block", *[F.sum(c).over(inside).alias(c) for c in STEP]).join(shifts, ["conv_id", "block"], "left")
    full = [(F.col(c) + F.coalesce(f"{c}_before", F.lit(0))).alias(c) for c in STEP]
    run = run.select("conv_id", "depth", *full)
    digest = F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in STEP[:4]], F.col("depth").cast("string")).cast("binary"))
    return run.select("conv_id", "depth", F.unhex(digest).alias("print"), "words")


def fattest(low: str, high: str) -> Column:
    """The number in (low, high] that most powers of two divide."""
    return F.expr(f"{high} & shiftleft(-1L, cast(length(bin({low} ^ {high})) - 1 as int))")


def at(walks: DataFrame, who: str, depth: str, name: str) -> DataFrame:
    return walks.select(F.col("sid").alias(who), F.col("depth").alias(depth), F.col("print").alias(name))


def with_handles(edges: DataFrame, walks: DataFrame) -> DataFrame:
    """Nodes (rep, low, high) with their prints: ``first`` at low + 1, ``handle`` at the two-fattest depth, ``tail`` at
    high. A node's extent is the first ``high`` turns of its ``rep``; ``low`` is the extent of its parent."""
    edges = edges.withColumn("fat", fattest("low", "high"))
    looked = edges.select("*", F.explode(F.array_distinct(F.array(F.col("low") + 1, "fat", "high"))).alias("depth")).join(at(walks, "rep", "depth", "print"), ["rep", "depth"])
    takes = [F.max(F.when(F.col("depth") == d, F.col("print"))).alias(n) for d, n in ((F.col("low") + 1, "first"), (F.col("fat"), "handle"), (F.col("high"), "tail"))]
    return looked.groupBy("rep", "low", "high", "fat").agg(*takes).drop("fat")


def locate(state: DataFrame, nodes: DataFrame, walks: DataFrame, steps: int) -> DataFrame:
    """Fat binary search of every string of ``state`` (sid, len, low): ``node`` is the deepest node whose handle is a
    prefix of the string, null if there is none below ``low``, the explicit depth that it is known to reach."""
    handles = nodes.select(F.col("handle").alias("probe"), F.struct("rep", "low", "high", "tail").alias("hit"))
    state = state.select("sid", "len", F.col("low").alias("known"), "low", F.col("len").alias("high"), F.lit(None).cast("struct<rep:long,low:long,high:long,tail:binary>").alias("node"))
    for _ in range(steps):
        asked = state.withColumn("fat", F.when(F.col("low") < F.col("high"), fattest("low", "high")))
        asked = asked.join(at(walks, "sid", "fat", "probe"), ["sid", "fat"], "left").join(handles, "probe", "left")
        high = F.when(F.col("hit").isNull() & F.col("fat").isNotNull(), F.col("fat") - 1).otherwise(F.col("high"))
        state = asked.select("sid", "len", "known", F.coalesce("hit.high", "low").alias("low"), high.alias("high"), F.coalesce("hit", "node").alias("node"))
    return state.select("sid", "len", "known", "node")


def exits(found: DataFrame, nodes: DataFrame, walks: DataFrame, stash: Stash) -> DataFrame:
    """(sid, len, edge, depth, branch): where each string leaves the trie. ``edge`` is the node on whose edge it leaves,
    null if it leaves at the end of an extent; ``branch`` is its print one turn further, null if it ends there."""
    step = F.col("node.high")
    rows = found.withColumn("depth", step).join(at(walks, "sid", "depth", "there"), ["sid", "depth"], "left")
    whole = F.col("node").isNull() | F.coalesce(F.col("there") == F.col("node.tail"), F.lit(False))
    rows = rows.select("sid", "len", "node", whole.alias("whole"), F.when(whole, F.coalesce(step, "known")).alias("deep"))
    rows = rows.withColumn("depth", F.col("deep") + 1).join(at(walks, "sid", "depth", "first"), ["sid", "depth"], "left").drop("depth")
    below = nodes.select("first", F.struct("rep", "low", "high", "tail").alias("child"))
    rows = rows.join(below, "first", "left")
    rows = stash.keep(rows.select("sid", "len", "deep", F.when(F.col("whole"), F.col("child")).otherwise(F.col("node")).alias("edge")))
    on = rows.where("edge is not null")
    on = on.select("sid", F.col("edge.rep").alias("rep"), F.explode(F.sequence(F.col("edge.low") + 1, F.least("edge.high", "len"))).alias("depth"))
    same = on.join(at(walks, "sid", "depth", "print"), ["sid", "depth"]).join(at(walks, "rep", "depth", "print"), ["rep", "depth", "print"])
    rows = rows.join(same.groupBy("sid").agg(F.max("depth").alias("common")), "sid", "left")
    rows = rows.select("sid", "len", "edge", F.coalesce("common", "deep").alias("depth")).withColumn("next", F.col("depth") + 1)
    return rows.join(at(walks, "sid", "next", "branch"), ["sid", "next"], "left").drop("next")


def build(strings: DataFrame, walks: DataFrame, stash: Stash) -> DataFrame:
    """The compacted nodes (rep, low, high, first, handle, tail) below the root for all ``strings`` (sid, len).

    A batch locates every string that is not in the trie yet, splits edges where strings leave them, and adds one new
    leaf for each distinct turn at each place where strings leave: the string with the smallest hash of its id. The
    others leave below that leaf in the next batch, so a batch settles every place at once and strings that branch off
    one after another along a path halve in expectation.
    """
    spark = strings.sparkSession
    nodes = spark.createDataFrame([], "rep long, low long, high long, first binary, handle binary, tail binary")
    pending, steps = stash.keep(strings.where("len > 0").select("sid", "len", F.lit(0).cast("long").alias("low"))), 0
    left = pending.count()
    while left:
        out = stash.keep(exits(locate(pending, nodes, walks, steps), nodes, walks, stash))
        leaves = out.where("branch is not null").groupBy("branch").agg(F.min_by(F.struct("sid", "depth", "len"), F.struct(F.xxhash64("sid"), "sid")).alias("leaf"))
        leaves = leaves.select(F.col("leaf.sid").alias("rep"), F.col("leaf.depth").alias("low"), F.col("leaf.len").alias("high"))
        cuts = out.where("edge is not null and depth < edge.high").select("edge.*", "depth").distinct()
        order = Window.partitionBy("tail").orderBy("depth")
        upper = cuts.select("rep", F.coalesce(F.lag("depth").over(order), "low").alias("low"), F.col("depth").alias("high"))
        lower = cuts.groupBy("tail", "rep", "high").agg(F.max("depth").alias("low")).select("rep", "low", "high")
        fresh = with_handles(leaves.unionByName(upper).unionByName(lower), walks)
        nodes = stash.keep(nodes.join(cuts.select("tail").distinct(), "tail", "left_anti").unionByName(fresh))
        rest = out.where("branch is not null").join(leaves.select(F.col("rep").alias("sid")), "sid", "left_anti")
        pending = stash.keep(rest.select("sid", "len", F.col("depth").alias("low")))
        left, steps = pending.agg(F.count("*"), F.max(F.length(F.bin(F.col("low").bitwiseXOR(F.col("len")))))).first()
    return nodes


def hashed_lists(ends: DataFrame) -> DataFrame:
    """(print, digest): SHA-256 of the decimal conv_ids of each print, ascending, with commas. Ranges of (print, conv_id)
    first make pieces of the lists, so that the task of a long list streams few rows through its hash."""

    def pieces(batches):
        mark, first, held = None, None, []

        def flush():
            columns = [pa.array([mark], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(held)], pa.string())]
            return pa.RecordBatch.from_arrays(columns, ["print", "first", "listed"])

        for batch in batches:
            for now, conv in zip(batch.column("print").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if held and (now != mark or len(held) >= LISTED):
                    yield flush()
                    held = []
                if not held:
                    mark, first = now, conv
                held.append(str(conv))
        if held:
            yield flush()

    def digests(batches):
        mark, state = None, None

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([mark], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["print", "digest"])

        for batch in batches:
            for now, listed in zip(batch.column("print").to_pylist(), batch.column("listed"), strict=True):
                if state is not None and now == mark:
                    state.update(b",")
                else:
                    if state is not None:
                        yield flush()
                    mark, state = now, hashlib.sha256()
                state.update(listed.as_py().encode())
        if state is not None:
            yield flush()

    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = ends.select("print", "conv_id").repartitionByRange(parts, "print", "conv_id").sortWithinPartitions("print", "conv_id")
    listed = ranges.mapInArrow(pieces, "print binary, first long, listed string")
    return listed.repartition(parts, "print").sortWithinPartitions("print", "first").mapInArrow(digests, "print binary, digest string")


SUMS = ["n", "total", "edge", "leaves"]


def subtree_sums(values: DataFrame, stash: Stash) -> DataFrame:
    """``values`` (id, up, n, total, edge, leaves, least) summed over all nodes below each one, itself included (the
    minimum for ``least``), by doubling the distance that a node's sums and its pointer reach."""
    now = stash.keep(values)
    while not now.where("up is not null").isEmpty():
        added = now.where("up is not null").groupBy(F.col("up").alias("id")).agg(*[F.sum(c).alias(f"{c}_more") for c in SUMS], F.min("least").alias("least_more"))
        further = now.where("up is not null").select(F.col("id").alias("up"), F.col("up").alias("beyond"))
        high, top = now.where(F.col("up") != root()), now.where((F.col("up") == root()) | F.col("up").isNull())  # nothing is beyond the root
        moved = high.join(further, "up", "left").drop("up").withColumnRenamed("beyond", "up").unionByName(top.withColumn("up", F.lit(None).cast("binary")))
        moved = moved.join(added, "id", "left")
        sums = [(F.col(c) + F.coalesce(f"{c}_more", F.lit(0))).alias(c) for c in SUMS]
        now = stash.keep(moved.select("id", "up", *sums, F.least("least", "least_more").alias("least")))
    return now


def prefix_nodes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row for each distinct prefix of the conversations ``convs`` (conv_id) with their ``turns`` (conv_id, depth,
    mark, words), from the empty one on.

    Equal conversations are one string of the trie with a count. Sums over subtrees follow from words and counts of the
    compacted nodes alone, as all prefixes on an edge have the same members.
    """
    stash = Stash(turns.sparkSession)
    prints = stash.keep(prefix_prints(turns))
    last = prints.groupBy("conv_id").agg(F.max(F.struct("depth", "print", "words")).alias("last"))
    none = F.lit(0).cast("long")
    last = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("last.depth", none).alias("len"), F.coalesce("last.print", root()).alias("print"), F.coalesce("last.words", none).alias("words"))
    last = stash.keep(last)
    strings = stash.keep(last.groupBy("print", "len", "words").agg(F.min("conv_id").alias("sid"), F.count("*").alias("n")))
    walks = stash.keep(prints.withColumnRenamed("conv_id", "sid").join(strings.select("sid"), "sid", "left_semi"))
    nodes = build(strings, walks, stash)

    above = walks.select(F.col("sid").alias("rep"), F.col("depth").alias("low"), F.col("print").alias("up"), F.col("words").alias("before"))
    until = walks.select(F.col("sid").alias("rep"), F.col("depth").alias("high"), F.col("words").alias("through"))
    edges = nodes.select("rep", "low", "high", F.col("tail").alias("id")).join(above, ["rep", "low"], "left").join(until, ["rep", "high"])
    edges = edges.select("id", F.coalesce("up", root()).alias("up"), "rep", "low", "high", F.coalesce("before", none).alias("before"), "through")
    top = strings.agg(F.min("sid").alias("rep")).where("rep is not null")
    top = top.select(root().alias("id"), F.lit(None).cast("binary").alias("up"), "rep", F.lit(-1).cast("long").alias("low"), none.alias("high"), none.alias("before"), none.alias("through"))
    edges = edges.unionByName(top)
    children = edges.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.count("*").alias("n_children"))
    ending = strings.select(F.col("print").alias("id"), "n", "sid", (F.col("n") * F.col("words")).alias("total"))
    edges = stash.keep(edges.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", none)))
    values = edges.join(ending, "id", "left").select(
        "id",
        "up",
        F.coalesce("n", none).alias("n"),
        F.coalesce("total", none).alias("total"),
        (F.col("through") - F.col("before")).alias("edge"),
        (F.col("n_children") == 0).cast("long").alias("leaves"),
        F.col("sid").alias("least"),
    )
    sums = subtree_sums(values, stash).drop("up")
    full = edges.join(sums, "id")
    full = full.join(sums.select(F.col("id").alias("up"), F.col("least").alias("up_least")), "up", "left").join(hashed_lists(last).withColumnRenamed("print", "id"), "id", "left")

    rows = full.withColumn("depth", F.explode(F.sequence(F.col("low") + 1, "high"))).withColumn("above", F.col("depth") - 1)
    rows = rows.join(walks.select(F.col("sid").alias("rep"), F.col("depth").alias("above"), F.col("words").alias("spent")), ["rep", "above"], "left")
    spent, ends_here = F.coalesce("spent", none), F.col("depth") == F.col("high")
    return rows.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.when(F.col("above") == F.col("low"), F.col("up_least")).otherwise(F.col("least")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(ends_here, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("total") - F.col("n") * spent - F.col("edge") + spent - F.col("before")).alias("saved_tokens"),
        F.when(ends_here, F.coalesce("digest", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """The prefix nodes of ``conversations`` (conv_id, turn, role, text) as they are.

    (conv_id, depth) names a node: the smallest member and the number of turns. Null role and text are empty; null turns
    come first; turns of equal number stand by role and text, so repeated rows are turns of their own; rows without
    conv_id belong to no conversation; an empty table has no node; other columns are not read.
    """
    numbered = Stash(conversations.sparkSession).keep(numbered_turns(conversations))
    return prefix_nodes(numbered.withColumnRenamed("place", "depth"), numbered.select("conv_id").distinct())


def rebuilt_nodes(conversations: DataFrame) -> DataFrame:
    """The prefix nodes of the registered query, whose conversations begin with turns of others; nulls as above. A
    conversation without a base and with no own turn left is a member of the root alone."""
    numbered = Stash(conversations.sparkSession).keep(numbered_turns(conversations))
    return prefix_nodes(*rebuilt(numbered))


_CRC = "list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), (2 * i + 1)::INT, 2))::UBIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda d, z: xor(d >> 1, 3988292384::UBIGINT * (d & 1))))"

ORACLE_SQL = rf"""
WITH own AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), marked AS (
  SELECT c, p, dense_rank() OVER (ORDER BY r, x) AS m, coalesce(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')), 0) AS w FROM own
), convs AS (
  SELECT c, c - c % {BASE} AS base, (xor({_CRC}, 4294967295::UBIGINT) % {KEPT})::BIGINT AS h FROM (SELECT DISTINCT c, c::VARCHAR AS f FROM own)
), turns AS (
  SELECT v.c, 0 AS part, o.p, o.m, o.w FROM convs v JOIN marked o ON o.c = v.base AND o.p <= v.h
  UNION ALL SELECT v.c, 1, o.p, o.m, o.w FROM convs v JOIN marked o ON o.c = v.c AND o.p > v.h
), seqs AS (
  SELECT v.c, coalesce(list(m ORDER BY part, p) FILTER (m IS NOT NULL), []) AS s, coalesce(list(w ORDER BY part, p) FILTER (m IS NOT NULL), []) AS ws
  FROM convs v LEFT JOIN turns t ON t.c = v.c GROUP BY v.c
), prefixes AS (
  SELECT c, s, d, list_slice(s, 1, d) AS pre, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM seqs)
), nodes AS (
  SELECT pre, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(s) = d), '')) AS ends_sha256
  FROM prefixes GROUP BY pre
), children AS (
  SELECT list_slice(pre, 1, depth - 1) AS pre, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), counted AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM nodes n LEFT JOIN children k USING (pre)
), under AS (
  SELECT list_slice(pre, 1, d) AS pre, sum((n_convs - 1) * w)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM counted) GROUP BY 1
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, u.n_leaves, u.saved_tokens, n.ends_sha256
FROM counted n JOIN under u USING (pre) LEFT JOIN nodes up ON n.depth > 0 AND up.pre = list_slice(n.pre, 1, n.depth - 1)
"""
