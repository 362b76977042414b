"""Merkle manifest of a dataset by time-forward processing.

Nodes are labelled by time: a node's label is the last leaf below it and its level, so that
children come before their parents. Nodes are visited in label order; a visited node sends its
digest forward to its parent through a priority queue that is ordered by the receiver's label,
and a node is due when the queue's head carries its label. The reversed sweep visits labels from
the last to the first: each node sends its proof, which is the suffix of its children's
proofs, and the siblings' digests to its children.

Spark's sorted shuffle is the external part of the queue. Runs of SPAN leaves make a block,
whose subtree is swept in one pass over its sorted rows with a queue in memory that holds at most
one run of FAN_OUT digests per level; what leaves a block goes to the next round, whose leaves
are the blocks' tops. Each round has SPAN times fewer rows than the one before, so a group of
any size is spread over as many tasks as it has blocks. Rounds are stored tables.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from criteria_engine.llm.tables import scratch, stored

FAN_OUT = 16
# Levels that one round goes up, and leaves of a block.
LEVELS = 2
SPAN = FAN_OUT**LEVELS
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

STEP = "struct<place:int,siblings:string>"


def digest(parts: str) -> str:
    return sha256(parts.encode()).hexdigest()


def field(value: Column) -> Column:
    """`-` for null, else the value's UTF-8 bytes counted, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, columns)), 256)


def depth(n: int) -> int:
    """Levels above n leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN_OUT), levels + 1
    return levels


def sweep(first: int, leaves: list[str], height: int) -> list[dict[int, list[str]]]:
    """Digests of a block: level 0 (the leaves) up to `height`, by run, in time order.

    `first` is the place of the block's first leaf. Level k of the result maps a run's place to
    the digests of its nodes on level k, which are the children of one node on level k + 1.
    """
    end = first + len(leaves) - 1
    levels: list[dict[int, list[str]]] = [{} for _ in range(height + 1)]
    queue: list[tuple[int, int, int, int, str]] = []

    def send(level: int, place: int, value: str) -> None:
        """To the parent, whose label is its last leaf and its level; then the child's place."""
        levels[level].setdefault(place // FAN_OUT, []).append(value)
        if level < height:
            width = FAN_OUT ** (level + 1)
            last = min((place * FAN_OUT**level // width + 1) * width - 1, end)
            heapq.heappush(queue, (last, level + 1, place // FAN_OUT, place, value))

    for time, value in enumerate(leaves, first):
        send(0, time, value)
        while queue and queue[0][0] == time:
            label = queue[0][:3]
            received = []
            while queue and queue[0][:3] == label:
                received.append(heapq.heappop(queue)[-1])
            send(label[1], label[2], digest("".join(received)))
    return levels


def reversed_sweep(first: int, levels: list[dict[int, list[str]]], above: list[tuple[int, str]]) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """Place and proof of every leaf of a block, the last one first.

    `above` is the proof of the block's top node. A proof is a list of steps (place within its
    run, digests of the run's others) from the leaf's level upwards.
    """
    height = len(levels) - 1
    end = first + sum(map(len, levels[0].values())) - 1

    def label(level: int, place: int) -> tuple[int, int, int]:
        return -min((place + 1) * FAN_OUT**level - 1, end), -level, place

    queue = [(label(height, first // FAN_OUT**height), above)]
    while queue:
        (_, level, place), proof = heapq.heappop(queue)
        level = -level
        if level == 0:
            yield place, proof
            continue
        run = levels[level - 1][place]
        for i in range(len(run)):
            step = (i, "".join(run[:i] + run[i + 1 :]))
            heapq.heappush(queue, (label(level - 1, place * FAN_OUT + i), [step, *proof]))


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, list[list]]]:
    """Rows of each (tree, block), sorted as they come, with columns as lists."""
    key, rows = None, [[] for _ in names]
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in names]
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        trees = batch.column("tree").to_pylist()
        for k in range(batch.num_rows):
            if key != (trees[k], blocks[k]):
                if key is not None:
                    yield key, rows
                key, rows = (trees[k], blocks[k]), [[] for _ in names]
            for to, column in zip(rows, columns):
                to.append(column[k])
    if key is not None:
        yield key, rows


def _height(tree_leaves: int) -> int:
    """Levels that a round goes up in a tree of so many leaves."""
    return min(LEVELS, depth(tree_leaves))


def _rise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[], [], [], []]
    for (tree, block), (places, counts, digests) in _blocks(batches, ["place", "n", "digest"]):
        top = sweep(places[0], digests, _height(counts[0]))[-1]
        made = (tree, block, -(-counts[0] // SPAN), next(iter(top.values()))[0])
        for to, value in zip(out, made):
            to.append(value)
        if len(out[0]) >= 4096:
            yield _nodes(out)
            out = [[], [], [], []]
    if out[0]:
        yield _nodes(out)


def _nodes(out: list[list]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["tree", "place", "n", "digest"])


def _by_block(nodes: DataFrame) -> DataFrame:
    """Blocks whole and in time order, as many to a task as hashing deals out."""
    blocks = nodes.withColumn("block", _block())
    return blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")


def _block() -> Column:
    return F.floor(F.col("place") / SPAN).cast("long")


def rounds(nodes: DataFrame, folder: str) -> list[DataFrame]:
    """`nodes` (tree, place, n leaves of the tree, digest) and the tops above, until each tree has one.

    A stored table per round. How many there are follows from the largest tree's leaves, one number.
    """
    out = [nodes]
    largest = nodes.agg(F.max("n")).first()[0] or 0
    while largest > 1:
        up = _by_block(out[-1].select("tree", "place", "n", "digest"))
        out.append(stored(up.mapInArrow(_rise, "tree long, place long, n long, digest string"), folder))
        largest = -(-largest // SPAN)
    return out


def _fall(batches: Iterator[pa.RecordBatch], rest: list[str]) -> Iterator[pa.RecordBatch]:
    """Proofs of a round's nodes; a block's first row is the message from above."""
    step = pa.list_(pa.struct([("place", pa.int32()), ("siblings", pa.string())]))
    kinds: dict[str, pa.DataType] = {}
    names = ["place", "n", "digest", "above", "crown", *rest]
    for (tree, _), rows in _blocks(_typed(batches, kinds), names):
        above, crown = rows[3][0], rows[4][0]
        places, counts, digests, _, _, *kept = (column[1:] for column in rows)
        levels = sweep(places[0], digests, _height(counts[0]))
        proofs: list = [None] * len(places)
        for place, proof in reversed_sweep(places[0], levels, [(s["place"], s["siblings"]) for s in above]):
            proofs[place - places[0]] = [{"place": p, "siblings": s} for p, s in proof]
        columns = [pa.array([tree] * len(places), pa.int64()), pa.array(places, pa.int64()), pa.array(digests, pa.string())]
        columns += [pa.array(x, kinds[c]) for c, x in zip(rest, kept)]
        columns += [pa.array([crown] * len(places), pa.string()), pa.array(proofs, step)]
        yield pa.RecordBatch.from_arrays(columns, ["tree", "place", "digest", *rest, "crown", "proof"])


def _typed(batches: Iterator[pa.RecordBatch], kinds: dict) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kinds.update({f.name: f.type for f in batch.schema})
        yield batch


def proofs(levels: list[DataFrame], messages: DataFrame, folder: str, rest: str = "") -> DataFrame:
    """Of the first round's nodes: tree, place, digest, the columns `rest` (their schema), crown, proof.

    `messages` (tree, above, crown) go to the top of every tree: what its proofs go on with, and
    a text that all its nodes get. A block gets its message as a row before its own, in the
    one shuffle that brings the block together.
    """
    given = rest.split(", ") if rest else []
    messages = messages.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(levels) - 1, -1, -1):
        extra = given if k == 0 else []
        names = [part.split()[0] for part in extra]
        nodes = levels[k].select("tree", _block().alias("block"), "place", "n", "digest", *names)
        rows = nodes.unionByName(messages.withColumn("place", F.lit(-1).cast("long")), allowMissingColumns=True)
        rows = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "place")
        kind = ", ".join(["tree long, place long, digest string", *extra, f"crown string, proof array<{STEP}>"])
        found = rows.mapInArrow(lambda batches, names=names: _fall(batches, names), kind)
        if k:
            messages = stored(found, folder).select(
                "tree", F.col("place").alias("block"), F.col("proof").alias("above"), "crown"
            )
    return found


def placed(rows: DataFrame, order: list[str], folder: str) -> DataFrame:
    """`rows` with place (from 0 in its tree, in the given order) and n, the tree's rows; stored.

    A tree may span many partitions: rows are cut by ranges and numbered behind the rows of the
    tree's earlier ranges.
    """
    parts = stored(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), folder)
    earlier = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy("tree", "part").agg(F.count("*").alias("size"))
    before = sizes.select(
        "tree", "part",
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"),
        F.sum("size").over(Window.partitionBy("tree")).alias("n"),
    )
    within = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    numbered = parts.withColumn("row", within).join(before, ["tree", "part"])
    out = numbered.withColumn("place", (F.col("before") + F.col("row")).cast("long")).drop("part", "row", "before")
    return stored(out, folder)


def tampered(text: Column, doc_id: Column) -> Column:
    """The text with A-Z lower-cased where 5 divides the id's checksum."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(text, UPPER, LOWER)).otherwise(text)


def fold(start: str, proof: list[dict]) -> str:
    """The root that a leaf and its proof give."""
    for step in proof:
        at, others = 64 * step["place"], step["siblings"]
        start = digest(others[:at] + start + others[at:])
    return start


def folded(rows: DataFrame, start: str, name: str = "folded_root") -> DataFrame:
    """`rows`, which have a `proof`, with the root that the digest in column `start` folds to."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fold(a, p) for a, p in zip(batch.column(start).to_pylist(), batch.column("proof").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, name])

    return rows.mapInArrow(run, f"{kinds}, {name} string")


def manifest(docs: DataFrame, **more: Column) -> DataFrame:
    """Leaf, subroot, root and proof of every row of `docs`; the tree of trees is kept in no other form.

    Returns doc_id, source, leaf, subroot, root, proof (an array of steps from the leaf to the
    root: place within its run, and the digests of the run's others, left to right) and `more`
    columns computed from the row, which must be texts. Columns that the table lacks count as null, others
    are ignored. Leaves of a source ascend by doc_id, null ids first; rows with equal ids by their
    leaf, so repeated rows have neighbouring leaves. Sources are ordered by their UTF-8 bytes, null
    first. A null source is a tree of its own. A single leaf is its source's subroot, a single subroot
    the root; its proof has no steps. An empty table has no rows and no root.
    """
    spark = docs.sparkSession
    folder = scratch(spark)
    kinds = {"doc_id": "long", "n_chars": "long"}
    given = [(F.col(c) if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS]
    extra = [value.cast("string").alias(f"more_{c}") for c, value in more.items()]
    # texts are read once; all later steps move digests
    rows = docs.select(*given, *extra)
    rows = rows.select("doc_id", "source", leaf([F.col(c) for c in COLUMNS]).alias("digest"), *[f"more_{c}" for c in more])
    rows = stored(rows, folder)
    # the sources in order, and for each a number that stands for it
    sources = rows.select("source").distinct().select(F.lit(0).cast("long").alias("tree"), "source")
    sources = placed(sources, ["source"], folder).select("source", F.col("place").alias("tree"))
    # a source with very many rows is split in this join, as both sides are plain tables
    numbered = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    numbered = numbered.select("tree", "r.doc_id", "r.source", "r.digest", *[f"r.more_{c}" for c in more])
    leaves = placed(numbered, ["doc_id", "digest"], folder)

    levels = rounds(leaves, folder)
    subroots = levels[-1].where("place = 0").select("tree", "digest")
    top = subroots.select(
        F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(subroots.count()).alias("n"), "digest"
    )
    tops = rounds(stored(top, folder), folder)
    root = tops[-1].first()
    none = spark.range(1).select(
        F.lit(0).cast("long").alias("tree"), F.array().cast(f"array<{STEP}>").alias("above"), F.lit("").alias("crown")
    )
    above = proofs(tops, none, folder) if root else tops[0].withColumn("proof", F.array().cast(f"array<{STEP}>"))
    above = stored(above.select(F.col("place").alias("tree"), F.col("proof").alias("above"), F.col("digest").alias("crown")), folder)
    rest = ["doc_id long", "source string", *[f"more_{c} string" for c in more]]
    found = proofs(levels, above, folder, ", ".join(rest))
    return found.select(
        "doc_id", "source", F.col("digest").alias("leaf"), F.col("crown").alias("subroot"),
        F.lit(root.digest if root else None).alias("root"), "proof", *[F.col(f"more_{c}").alias(c) for c in more],
    )
