"""SimHash near-duplicates through a byte-position inverted index with count filtering.

A fingerprint of k bytes is indexed under groups of byte positions. Two 64-bit fingerprints that differ in 3 bits
at most share 5 of their 8 positional bytes; of any 5 positions, 3 lie in one half of the 8, so the 8 triples
within the halves lead to every such pair (`TRIPLES`). Postings of single bytes would meet a 256th of the
corpus each; triples meet a 2^24th. Within a posting list, shared positional bytes are tallied, pairs below
the guaranteed minimum are dropped and the rest is verified bit by bit.

Posting lists are walked as components: from each text to the ones not yet reached, so a list of near copies
costs about its length and gives its length in links (to the smallest member), never all pairs. Lists longer than
`BLOCK` are walked in blocks by many tasks without losing a link (`group_links`). Equal fingerprints
are collapsed before. Components over all lists come from alternating star contraction on stored tables.

Shingles of five words at a similarity of 0.8 move 8 to 17 of 64 SimHash bits, which guarantees no shared byte.
`near_duplicates`, which has to find those, therefore takes SimHash links (3 bits) as candidates and adds fingerprints
whose bytes are one-byte min-wise hashes of the same shingles in the same index: bytes agree at about the similarity,
bands of 4 positions are the postings. The share of 128 positional bytes estimates the similarity with an error of
0.035, so the tally is a filter only and stands over three errors below 0.8. It and the SimHash links give clusters of
candidates; within a cluster the texts are walked again, in blocks where it is large, and a link there is a Jaccard similarity of 0.8 or more of
the two sets of shingle hashes. A pair at 0.8 shares a band with a chance of 0.998 and passes the tally with 0.999.

Defined cases: null texts, empty texts and texts without words have fingerprint zero and link like others; fewer
words than a shingle make one shingle; texts of any length count whole; a bit that is set in exactly half of the
hashes is 0; equal rows get equal results; rows may lack a doc_id, a component has the smallest one
in it that isn't null, or null where all lack it; an empty table gives no rows; extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import mixed, stored, tuned, utf8

MAX_BITS = 3
#: Positions of the posting keys: every triple within either half of the eight bytes.
TRIPLES = [c for half in (range(4), range(4, 8)) for c in combinations(half, 3)]
#: Shared positional bytes that a pair within MAX_BITS has at least.
LEAST_BYTES = 8 - MAX_BITS
#: Min-wise bytes of a text, positions to a posting key, posting keys, shared bytes that make a candidate.
MIN_BYTES, BAND, BANDS, LEAST_MIN_BYTES = 128, 4, 12, 88
#: Percent of the shingles of two texts together that near duplicates share.
SIMILARITY = 80
#: Rows and bytes of a block of a posting list or cluster; members of a larger one that stand in all its blocks, about.
BLOCK, BLOCK_BYTES, LEADERS = 256, 1 << 25, 16
#: Hashes looked up at once.
AT_ONCE = 1 << 20

_MULTIPLY = mixed(np.arange(1, MIN_BYTES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mixed(np.arange(1, MIN_BYTES + 1, dtype=np.uint64) + np.uint64(1 << 40))


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of the A-Z-lowered text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.split takes 0x20 and 0x09-0x0D
    if not found:
        return np.zeros(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = (ends - [len(w) + 1 for w in found])[: len(found) - words + 1].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64)


def simhash(h: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; 0 without hashes."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i : i + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def min_bytes(h: np.ndarray) -> bytes:
    """One byte per position of the smallest of the position's permuted shingle hashes."""
    h = np.unique(h) if len(h) < 64 else h
    if not len(h):
        return bytes(MIN_BYTES)
    least = np.full(MIN_BYTES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 512):
        np.minimum(least, (h[i : i + 512, None] * _MULTIPLY + _ADD).min(0), out=least)
    return (mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def _place() -> list:
    """Where a text stands: hashes of the text and of its doc_id."""
    return [F.xxhash64("text").alias("of"), F.xxhash64("doc_id").alias("at")]


def fingerprints(documents: DataFrame, words: int = 3, min_wise: bool = False) -> DataFrame:
    """doc_id, fp (the 64 bits as long) and, if asked for, mins (binary), digest (of the A-Z-lowered word sequence), size (bytes of the shingle hashes), of and at (hashes of text and doc_id)."""
    tuned(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, mins, digests, sizes = [], [], [], []
            for text in b.column(1).to_pylist():
                h = shingle_hashes(text, words)
                fp = simhash(h)
                fps.append(fp - (1 << 64) if fp >> 63 else fp)
                if min_wise:
                    mins.append(min_bytes(h))
                    digests.append(xxhash.xxh3_128_digest(h.tobytes()))
                    sizes.append(h.nbytes)
            out = [b.column(0), pa.array(fps, pa.int64())]
            names = ["doc_id", "fp"]
            if min_wise:
                out, names = [*out, pa.array(mins, pa.binary()), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), b.column(2), b.column(3)], [*names, "mins", "digest", "size", "of", "at"]
            yield pa.RecordBatch.from_arrays(out, names)

    kind = dict(documents.dtypes)["doc_id"]
    columns = ["doc_id", "text", *_place()] if min_wise else ["doc_id", "text"]
    return documents.select(*columns).mapInArrow(run, f"doc_id {kind}, fp long" + ", mins binary, digest binary, size long, of long, at long" * min_wise)


def _walk(n: int, near) -> np.ndarray:
    """Smallest member of each member's component; near(i, others) tells which of `others` link to i."""
    root, open_ = np.arange(n), np.arange(n)
    while len(open_):
        start, queue = open_[0], [open_[0]]
        open_ = open_[1:]
        while queue and len(open_):
            hit = near(queue.pop(), open_)
            if hit.any():
                reached = open_[hit]
                root[reached] = start
                queue += reached.tolist()
                open_ = open_[~hit]
    return root


def _across(near, label: np.ndarray, query: np.ndarray) -> tuple[list[int], list[int]]:
    """Links from queries to the other rows that join all labels the queries link to; a joined label counts as the query's own."""
    label, rest = label.copy(), np.flatnonzero(~query)
    us, vs = [], []
    for i in np.flatnonzero(query).tolist():
        others = rest[label[rest] != label[i]]
        if not len(others):
            continue
        hit = others[near(i, others)]
        met, first = np.unique(label[hit], return_index=True)
        us += [i] * len(first)
        vs += hit[first].tolist()
        label[np.isin(label, met)] = label[i]
    return us, vs


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows sorted by cell as tables of whole cells, with the cells' bounds; rows that come twice in a cell come once."""
    waiting: list[pa.RecordBatch] = []
    for b in chain(batches, [None]):
        if b is not None:
            if not b.num_rows:
                continue
            waiting.append(b)
            if waiting[0].column(0)[0] == b.column(0)[-1]:  # one cell goes on
                continue
        if not waiting:
            continue
        table = pa.Table.from_batches(waiting).combine_chunks()
        same = np.ones(max(0, table.num_rows - 1), bool)
        for name in {"cell", "id", "query"} & set(table.column_names):
            values = table.column(name).to_numpy()
            same &= values[1:] == values[:-1]
        if same.any():
            table = table.filter(pa.array(np.concatenate([[True], ~same]))).combine_chunks()
        cell = table.column(0).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
        bounds = np.append(starts, len(cell))
        if b is not None:  # the last cell may go on in the next batch
            bounds = bounds[:-1]
        yield table, bounds
        waiting = table.slice(bounds[-1]).to_batches() if b is not None else []


def _cell_links(rows: DataFrame, near_of) -> DataFrame:
    """rows: cell, id and what `near_of` reads. Links u, v within each cell: stars around the smallest id of a component, or, with columns label and query, what `_across` finds."""
    across = "query" in rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _cells(batches):
            ids, near_in = table.column("id").to_numpy(), near_of(table)
            us, vs = [], []
            for k in np.flatnonzero(np.diff(bounds) > 1):
                a, z = int(bounds[k]), int(bounds[k + 1])
                if across:
                    u, v = _across(near_in(a, z), table.column("label").to_numpy()[a:z], table.column("query").to_numpy()[a:z])
                else:
                    root = _walk(z - a, near_in(a, z))
                    u = np.flatnonzero(root != np.arange(z - a))
                    v = root[u]
                us.append(ids[a:z][u])
                vs.append(ids[a:z][v])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], ["u", "v"])

    order = ["cell", "query", "id"] if across else ["cell", "id"]
    return rows.repartition("cell").sortWithinPartitions(*order).mapInArrow(run, "u long, v long")


def _blocks():
    """Blocks that a group of rows of column size is dealt into."""
    return F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("size") / F.lit(BLOCK_BYTES)))


def group_links(members: DataFrame, near_of, load=lambda placed: placed) -> DataFrame:
    """members: key, id, size (bytes) and more. Links u, v whose components are those of near rows within each group (rows of one key).

    Groups of one block are cells. Larger ones are dealt into blocks by a hash of the id, and some members, its leaders,
    stand in all blocks; components over the blocks' links then join most of a group of near rows. Two near rows that
    are still apart can't both be in the group's largest component: the rows outside it are queries, in blocks, against
    all blocks of the group. So no link is lost and no task has more than about two blocks. `load` adds what `near_of`
    reads to placed rows.
    """
    large = stored(members.groupBy("key").agg(F.count("*").alias("n"), _blocks().alias("blocks")).where("blocks > 1"), "large")
    if large.isEmpty():
        return _cell_links(load(members.withColumnRenamed("key", "cell").drop("size")), near_of)
    whose = lambda n: F.pmod(F.xxhash64(F.lit("block"), "id"), n)
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    leads = F.pmod(F.xxhash64(F.lit("leader"), "id"), F.col("n")) < F.least(F.lit(LEADERS), F.ceil(F.col("n") / F.col("blocks") / 4))
    at = F.explode(F.when(F.isnull("blocks"), F.array(F.lit(None).cast("long"))).when(leads, upto(F.col("blocks"))).otherwise(F.array(whose(F.col("blocks")))))
    placed = members.join(large, "key", "left").withColumn("at_block", at)
    placed = placed.withColumn("cell", F.when(F.isnull("at_block"), F.col("key")).otherwise(F.xxhash64("key", "at_block")))
    extra = [c for c in members.columns if c not in ("key", "id", "size")]
    roots = stored(components(_cell_links(load(placed.select("cell", "id", *extra)), near_of)), "roots")
    links = roots.toDF("u", "v")
    labelled = members.join(large, "key").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("root", "id")).drop("root", "n")
    labelled = stored(labelled, "labelled")
    most = labelled.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    labelled = labelled.join(most, "key").withColumn("query", F.col("label") != F.col("most"))
    asked = stored(labelled.where("query").groupBy("key").agg(_blocks().alias("query_blocks")), "asked")
    if asked.isEmpty():
        return links
    rows = labelled.join(asked, "key")
    queries = rows.where("query").withColumn("a", whose(F.col("query_blocks"))).withColumn("b", F.explode(upto(F.col("blocks"))))
    others = rows.withColumn("query", F.lit(False)).withColumn("a", F.explode(upto(F.col("query_blocks")))).withColumn("b", whose(F.col("blocks")))
    cells = queries.unionByName(others).withColumn("cell", F.xxhash64("key", "a", "b"))
    return links.union(_cell_links(load(cells.select("cell", "id", *extra, "label", "query")), near_of))


def _links(postings: DataFrame, width: int) -> DataFrame:
    """postings: key, id, sig (binary of `width` bytes). Links u, v that join the near members of each posting list."""

    def near_of(table: pa.Table):
        sigs = _matrix(table.column("sig"), width)

        def near_bytes(a: int, z: int):
            sig = sigs[a:z]
            return lambda i, others: (sig[others] == sig[i]).sum(1) >= LEAST_MIN_BYTES

        def near_bits(a: int, z: int):
            sig, value = sigs[a:z], sigs[a:z].copy().view(np.uint64)[:, 0]
            return lambda i, others: ((sig[others] == sig[i]).sum(1) >= LEAST_BYTES) & (np.bitwise_count(value[others] ^ value[i]) <= MAX_BITS)

        return near_bits if width == 8 else near_bytes

    return group_links(postings.select("key", "id", F.lit(width).alias("size"), "sig"), near_of)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return utf8(column)[0].reshape(-1, width)


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) for every node of links (u, v); alternating star contraction.

    Minima are combined before they are shuffled and stored, so that each join is between two plain exchanges, whose
    large partitions adaptive execution splits: a node with very many neighbours isn't one task's. Each round at least
    halves the nodes that aren't settled, and rounds go on until all are.
    """
    links = stored(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    least = stored(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    while not _stars(links, least):
        # large star: the smaller end of a link moves to the smallest of its own neighbours
        met = links.join(least.select(F.col("u").alias("v"), "m"), "v", "left")
        links = stored(met.select("u", F.coalesce("m", "v").alias("v")).distinct(), "links")
        least = stored(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        # small star: a node's smaller neighbours, and itself, move to the smallest of them
        rest = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(rest.union(least.select("u", "m")).distinct(), "links")
        least = stored(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _stars(links: DataFrame, least: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none to a smaller one."""
    return least.where("n > 1").isEmpty() and links.join(least.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def _byte(fp: str, i: int):
    return F.shiftrightunsigned(F.col(fp), 8 * i).bitwiseAND(F.lit(255))


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links between the distinct fingerprints in column fp that differ in MAX_BITS bits at most, as u and v."""
    keys = F.array(*[F.lit(n).cast("long") * (1 << 24) + sum((_byte("fp", i) * (1 << 8 * j) for j, i in enumerate(c)), F.lit(0)) for n, c in enumerate(TRIPLES)])
    # fp is the id, as the ids are the fingerprints themselves; sig is their bytes, whose order is one for all
    return _links(fps.select(F.explode(keys).alias("key"), F.col("fp").alias("id"), F.unhex(F.lpad(F.hex("fp"), 16, "0")).alias("sig")), 8)


def simhash_components(documents: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id (smallest doc_id reachable over links of MAX_BITS bits) per document."""
    rows = stored(fingerprints(documents, words), "fingerprints")
    firsts = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
    found = components(fingerprint_links(firsts.select("fp")))
    named = firsts.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = stored(named.select("fp", "root").join(ids, "root").select("fp", "component_id"), "components")
    return rows.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _similar(fp: np.ndarray, sig: np.ndarray, hashes: np.ndarray, cuts: np.ndarray):
    """near(i, others) of `_walk`: candidates by bits or bytes whose shingle sets (sorted, hashes[cuts[i]:cuts[i + 1]]) have the similarity."""
    sizes = np.diff(cuts)

    def near(i: int, others: np.ndarray) -> np.ndarray:
        hit = (np.bitwise_count(fp[others] ^ fp[i]) <= MAX_BITS) | ((sig[others] == sig[i]).sum(1) >= LEAST_MIN_BYTES)
        hit &= 100 * np.minimum(sizes[others], sizes[i]) >= SIMILARITY * np.maximum(sizes[others], sizes[i])
        at, mine = np.flatnonzero(hit), np.array(hashes[cuts[i] : cuts[i + 1]])
        step = max(1, AT_ONCE // max(1, 2 * len(mine)))
        for part in (at[lo : lo + step] for lo in range(0, len(at), step)):
            theirs = np.concatenate([hashes[cuts[j] : cuts[j + 1]] for j in others[part]])
            found = np.concatenate([[0], np.cumsum(mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs if len(mine) else theirs > theirs)])
            ends = np.cumsum(sizes[others[part]])
            shared = found[ends] - found[ends - sizes[others[part]]]
            hit[part] = 100 * shared >= SIMILARITY * (sizes[others[part]] + len(mine) - shared)
        return hit

    return near


def verified(documents: DataFrame, members: DataFrame, words: int = 5) -> DataFrame:
    """members: key (cluster), id, size, of, at, fp, mins. Links u, v that join the members of each cluster over pairs of the similarity."""

    def load(placed: DataFrame) -> DataFrame:
        more = [c for c in ("label", "query") if c in placed.columns]

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = set()
            for b in batches:
                rows = [tuple(x) for x in zip(*[b.column(n).to_pylist() for n in ("cell", "id", *more)], strict=True)]
                new = [i for i, x in enumerate(rows) if x not in seen and not seen.add(x)]  # rows equal in id and text come once
                b = b.take(pa.array(new, pa.int64()))
                sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sets, pa.binary())], [*b.schema.names[1:], "shingles"])

        texts = documents.select("text", *_place()).join(placed, ["of", "at"]).select("text", "cell", "id", "fp", "mins", *more)
        kinds = "cell long, id long, fp long, mins binary" + ", label long, query boolean" * bool(more)
        return texts.mapInArrow(hashed, f"{kinds}, shingles binary")

    def near_of(table: pa.Table):
        fps, sigs = table.column("fp").to_numpy().view(np.uint64), _matrix(table.column("mins"), MIN_BYTES)
        data, offsets = utf8(table.column("shingles"))
        hashes, cuts = data.view(np.uint64), offsets // 8
        return lambda a, z: _similar(fps[a:z], sigs[a:z], hashes, cuts[a : z + 1])

    return group_links(members, near_of, load)


def near_duplicates(documents: DataFrame, words: int = 5) -> DataFrame:
    """doc_id and component_id (the smallest doc_id reachable over links of shingle similarity 0.8 or more)."""
    rows = stored(fingerprints(documents, words, min_wise=True), "fingerprints")
    least = F.min("doc_id")
    texts = stored(rows.groupBy("digest").agg(least.alias("first"), F.first("fp").alias("fp"), F.first("mins").alias("mins"), F.first("size").alias("size"), F.min(F.struct("of", "at")).alias("place")), "texts")
    texts_id = texts.withColumn("id", F.xxhash64("digest"))
    by_mins = texts_id.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.substring("mins", i * BAND + 1, BAND))).alias("n", "band"), "id", F.col("mins").alias("sig"))
    near = _links(by_mins.select(F.xxhash64("n", "band").alias("key"), "id", "sig"), MIN_BYTES)
    fps = texts_id.groupBy("fp").agg(F.min("id").alias("id"))
    same_fp = texts_id.join(fps.withColumnRenamed("id", "v"), "fp").select(F.col("id").alias("u"), "v").where("u <> v")
    bits = fingerprint_links(fps.select("fp")).join(fps.toDF("u", "ui"), "u").join(fps.toDF("v", "vi"), "v").select(F.col("ui").alias("u"), F.col("vi").alias("v"))
    clusters = components(near.union(same_fp).union(bits)).toDF("id", "key")
    clusters = clusters.union(clusters.select("key", "key")).distinct()
    members = stored(texts_id.join(clusters, "id").select("key", "id", "size", "place.*", "fp", "mins"), "members")
    found = components(verified(documents, members, words))
    named = texts_id.select("digest", "id", "first").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    ids = named.groupBy("root").agg(F.min("first").alias("component_id"))
    of = stored(named.select("digest", "root").join(ids, "root").select("digest", "component_id"), "components")
    return rows.select("doc_id", "digest").join(of, "digest").select("doc_id", "component_id")
