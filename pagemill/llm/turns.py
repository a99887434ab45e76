"""The prefix trie of conversations by prefix doubling.

Turns get dense names (a number for each distinct role and text), then blocks of two, four, eight turns and so on get
dense names from the pair of names of their halves, one join a round: as many rounds as the longest conversation has binary
digits. A prefix of d turns is the sequence of the blocks that the binary digits of d say, largest first, so conversations
share a prefix just if those names are equal; grouping by them gives the nodes.

A node is known by its smallest member and its depth: the smallest member of a prefix owns the nodes from some depth down to its
end. So what is summed over a node's subtree is, over its members, the weight of all nodes that each owns, less
that of the nodes above that the smallest member owns: two groupings, no walk over the tree.

Dense names come from ranks within hash buckets (name = rank * buckets + bucket), so naming has no single task. Equal
turns, prefixes and conversations are counted before they are shuffled, or meet in joins that adaptive execution splits;
a very long conversation is ordered in ranges and summed in spans. The members that end in a node are joined in blocks of
ids, which stream through the digest.

Defined cases: rows of equal turn come in the order of a digest of role and text, equal rows are turns of their own; rows without a
conv_id belong to no conversation and are left out; conv_ids are whole numbers; texts of any length count by digest and length;
an empty table has no nodes, not even a root; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import stored

#: Conversations whose first turns one of them shares, and the most of those turns.
GROUP, MOST_SHARED = 100, 5
#: Hash buckets that share out names, at least, and rows to a bucket.
BUCKETS, PER_BUCKET = 64, 50_000
#: Binary digits of the depths of a conversation that are summed in one task, and of the ids of members that are joined to one string.
SPAN, IDS = 10, 12


def shared_turns(conv_id: Column) -> Column:
    """How many first turns a conversation takes from its group's first one."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")


def ordered(conversations: DataFrame) -> DataFrame:
    """conv, i (from 0), digest and chars of every turn, in order. A digest is of role and text; equal rows are counted first."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    counted = rows.groupBy("conv", "turn", "digest", "chars").agg(F.count("*").alias("copies"))
    by = [F.col("conv"), F.asc_nulls_first("turn"), F.col("digest")]
    parts = stored(counted.repartitionByRange(*by).withColumn("part", F.spark_partition_id()), "turns")
    upto = F.sum("copies").over(Window.partitionBy("conv", "part").orderBy(*by[1:]).rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    earlier = parts.groupBy("conv", "part").agg(F.sum("copies").alias("n")).select("conv", "part", F.coalesce(before, F.lit(0)).alias("before"))
    end = F.col("before") + F.col("upto")
    placed = parts.withColumn("upto", upto).join(earlier, ["conv", "part"])
    return placed.select("conv", F.explode(F.sequence(end - F.col("copies"), end - 1)).alias("i"), "digest", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv, n turns) and their turns (conv, i, digest, chars, n), the first ones taken from the group's first conversation."""
    turns = stored(ordered(conversations), "ordered")
    own = turns.groupBy("conv").agg(F.count("*").alias("own")).withColumns({"shared": shared_turns(F.col("conv")), "base": F.col("conv") - F.col("conv") % GROUP})
    bases = own.where("conv = base").select(F.col("conv").alias("base"), F.least("own", F.lit(MOST_SHARED)).alias("there"))
    taken = F.least("shared", F.coalesce("there", F.lit(0))).cast("long")
    convs = own.join(bases, "base", "left").withColumn("taken", taken).withColumn("n", F.col("taken") + F.greatest(F.col("own") - F.col("shared"), F.lit(0)))
    convs = stored(convs.select("conv", "base", "shared", "taken", "n"), "conversations")
    heads = turns.where((F.col("i") < MOST_SHARED) & (F.col("conv") % GROUP == 0)).withColumnRenamed("conv", "base")
    first = convs.join(heads, "base").where("i < taken").select("conv", "i", "digest", "chars", "n")
    rest = turns.join(convs, "conv").where("i >= shared").select("conv", (F.col("i") - F.col("shared") + F.col("taken")).alias("i"), "digest", "chars", "n")
    return convs.select("conv", "n"), first.unionByName(rest)


def named(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """rows with name, a dense number for each distinct value of keys."""
    distinct = rows.select(*keys).distinct().withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys)).cast("long") - 1
    return rows.join(distinct.select(*keys, (rank * buckets + F.col("bucket")).alias("name")), keys).drop(*keys)


def blocks(turns: DataFrame, longest: int, rows: int) -> list[DataFrame]:
    """conv, b, name and n of the blocks of 2^level turns at b * 2^level, for each level."""
    buckets = max(BUCKETS, rows // PER_BUCKET)
    levels = [stored(named(turns.select("conv", F.col("i").alias("b"), "digest", "n"), ["digest"], buckets), "level-0")]
    while 1 << len(levels) <= longest:
        half = lambda odd: F.max(F.when(F.col("b") % 2 == odd, F.col("name")))
        pairs = levels[-1].groupBy("conv", F.shiftright("b", 1).alias("b")).agg(half(0).alias("left"), half(1).alias("right"), F.max("n").alias("n")).where("right is not null")
        levels.append(stored(named(pairs, ["left", "right"], buckets), f"level-{len(levels)}"))
    return levels


def prefixes(levels: list[DataFrame]) -> DataFrame:
    """conv, depth and key, the names of the blocks that make up the first `depth` turns."""
    parts = []
    for level, found in enumerate(levels):  # a block at an even multiple of its size is part of the prefixes that end in the next one
        size = 1 << level
        at = F.col("b") * size
        depths = F.sequence(at + size, F.least(at + (2 * size - 1), F.col("n")))
        parts.append(found.where("b % 2 = 0").select("conv", F.explode(depths).alias("depth"), F.struct(F.lit(-level).alias("level"), "name").alias("block")))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("conv", "depth").agg(F.transform(F.array_sort(F.collect_list("block")), lambda x: x["name"]).alias("key"))


def _digests(members: DataFrame) -> DataFrame:
    """conv_id, depth and ends_sha256 of nodes, from conv_id, depth and conv of the conversations that end there."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    strings = members.groupBy("conv_id", "depth", F.shiftright("conv", IDS).alias("part")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for b in batches:
            done = []
            for c, d, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if (c, d) != node:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (c, d), hashlib.sha256(ids.encode())
                else:
                    digest.update(f",{ids}".encode())
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "depth", "ends_sha256"), x, strict=True)) for x in done], schema)
        if node:
            yield pa.RecordBatch.from_pylist([{"conv_id": node[0], "depth": node[1], "ends_sha256": digest.hexdigest()}], schema)

    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    streams = strings.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part").select("conv_id", "depth", "ids")
    return streams.mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    convs, turns = rebuilt(conversations)
    turns = stored(turns, "rebuilt")
    sizes = convs.agg(F.max("n").alias("longest"), F.sum("n").alias("rows"), F.min("conv").alias("first")).first()
    found = stored(prefixes(blocks(turns, sizes["longest"] or 0, sizes["rows"] or 0)), "prefixes")
    root = F.lit(sizes["first"]).cast("long")

    groups = found.groupBy("depth", "key").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    groups = stored(groups, "groups")
    member = found.join(groups.select("depth", "key", "conv_id"), ["depth", "key"]).select("conv", "depth", "conv_id")
    member = stored(member.unionByName(convs.select("conv", F.lit(0).cast("long").alias("depth"), root.alias("conv_id"))), "members")  # a row for each conversation and each of its prefixes

    # a node's parent is the node of its smallest member one turn shorter; its last text that member's
    up = member.select(F.col("conv").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    last = turns.select(F.col("conv").alias("conv_id"), (F.col("i") + 1).alias("depth"), "chars")
    nodes = groups.select("conv_id", "depth", "n_convs").join(up, ["conv_id", "depth"]).join(last, ["conv_id", "depth"])
    top = convs.agg(F.count("*").alias("n_convs")).where("n_convs > 0").select(root.alias("conv_id"), F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(None).cast("long").alias("parent_conv_id"), F.lit(0).cast("long").alias("chars"))
    nodes = stored(nodes.unionByName(top), "nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    own = nodes.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    own = stored(own.withColumns({"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}).drop("chars"), "weighed")

    weights = ["leaf", "saved"]
    whole = own.groupBy(F.col("conv_id").alias("conv")).agg(*[F.sum(w).alias(w) for w in weights])
    below = member.join(whole, "conv").groupBy("conv_id", "depth").agg(*[F.sum(w).alias(f"{w}_below") for w in weights])
    ends = _digests(convs.join(member, (convs["conv"] == member["conv"]) & (convs["n"] == member["depth"])).select("conv_id", "depth", convs["conv"]))

    # of the nodes that one conversation owns, those above: within spans of depths, and over the spans
    cut = own.withColumn("span", F.shiftright("depth", SPAN))
    before = Window.partitionBy("conv_id", "span").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    spans = cut.groupBy("conv_id", "span").agg(*[F.sum(w).alias(f"{w}_span") for w in weights])
    over = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("conv_id", "span", *[F.coalesce(F.sum(f"{w}_span").over(over), F.lit(0)).alias(f"{w}_span") for w in weights])
    above = cut.withColumns({f"{w}_above": F.coalesce(F.sum(w).over(before), F.lit(0)) for w in weights}).join(spans, ["conv_id", "span"])

    total = lambda w: (F.col(f"{w}_below") - F.col(f"{w}_above") - F.col(f"{w}_span")).cast("long")
    out = above.join(below, ["conv_id", "depth"]).join(ends, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", total("leaf").alias("n_leaves"), total("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
