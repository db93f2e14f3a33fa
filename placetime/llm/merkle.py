"""A Merkle manifest of a dataset: one root, and for each row the proof that it is part of it.

Rows are leaves of one tree per group; the groups' roots are leaves of the tree above. Both are built by
time-forward processing: nodes are visited in the order of their labels, and a priority queue ordered by
label hands a node the digests of its children. A reversed sweep hands each node the rest of the
proof, from the root down to the leaves. Spark is the queue's external part: between rounds, digests
are written, and sorted by tree, block and label; in a task the queue holds one block.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetime.llm.ordered import places
from placetime.llm.tables import Tables

ARITY = 3
#: Levels that one round climbs; a block of one task's sweep has at most ARITY ** LEVELS leaves.
LEVELS = 5
FLUSH_ROWS = 2000

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree string, index long, level int, digest string"


def leaf(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field as `-` if null, else its length in UTF-8 bytes, `:` and its value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


def digest(children: str) -> str:
    return hashlib.sha256(children.encode()).hexdigest()


# Sweeps over one block: its leaves have the places 0, 1, 2 ...; a node's children are `arity` neighbours.


def forward(digests: Iterable[str], arity: int = ARITY) -> tuple[int, str, list[tuple[int, int, list[str]]]]:
    """(level and digest of the block's root, runs); a run is a node's level, place and children's digests.

    A message waits in the queue under the label of the node it is for: the last leaf that node can have,
    then its level. As leaves arrive, all nodes labelled earlier are complete. The last node of a
    level has fewer children, maybe one; as soon as one message is left, it is the root.
    """
    queue: list[tuple[int, int, int, str]] = []
    runs = []

    def deliver() -> None:
        last, level, at, first = heapq.heappop(queue)
        children = [first]
        while queue and queue[0][:2] == (last, level):
            children.append(heapq.heappop(queue)[3])
        place = at // arity
        runs.append((level, place, children))
        send(level, place, digest("".join(children)))

    def send(level: int, place: int, value: str) -> None:
        last = (place // arity + 1) * arity ** (level + 1) - 1
        heapq.heappush(queue, (last, level + 1, place, value))

    for place, value in enumerate(digests):
        while queue and queue[0][0] < place:
            deliver()
        send(0, place, value)
    while len(queue) > 1:
        deliver()
    _, above, _, root = queue[0]
    return above - 1, root, runs


def backward(runs: Sequence[tuple[int, int, list[str]]], level: int, rest: str, arity: int = ARITY) -> dict[int, str]:
    """The path of every leaf: nodes in reversed order hand their children the step to themselves and their own path.

    A step is the run's digests with `*` for the node's own one, and `/`; `rest` is the root's path.
    """
    waiting = {(level, 0): rest}
    for level, place, children in reversed(runs):
        path = waiting.pop((level, place))
        for at in range(len(children)):
            step = "".join(children[:at]) + "*" + "".join(children[at + 1 :])
            waiting[level - 1, place * arity + at] = f"{step}/{path}"
    return {place: path for (_, place), path in waiting.items()}


def _blocks(batches: Iterator[pa.RecordBatch], columns: Sequence[str]) -> Iterator[tuple[pa.Schema, dict[str, list]]]:
    """The rows' schema and the column lists of each block's consecutive rows."""
    block: dict[str, list] = {}
    key = schema = None
    for batch in batches:
        schema = batch.schema
        rows = {name: batch.column(name).to_pylist() for name in columns}
        keys = list(zip(rows["tree"], rows["block"]))
        start = 0
        while start < len(keys):
            end = start + 1
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            if keys[start] != key:
                if block:
                    yield schema, block
                key, block = keys[start], {name: [] for name in columns}
            for name in columns:
                block[name] += rows[name][start:end]
            start = end
    if block:
        yield schema, block


def _lifted(indexes: list[int], levels: list[int], digests: list[str], base: int) -> tuple[list[str], list[int]]:
    """Digests at level `base`, and how often each was hashed alone to get there. A tree's last node may be lower; a tree's
    first node is only when it is the tree's root, which stays."""
    out, times = [], []
    for index, level, value in zip(indexes, levels, digests):
        missing = base - level if index else 0
        for _ in range(missing):
            value = digest(value)
        out.append(value)
        times.append(missing)
    return out, times


def _climb(nodes: DataFrame, done: int) -> DataFrame:
    """The roots of all blocks, as the nodes of the next round."""
    base = done * LEVELS
    schema = pa.schema([("tree", pa.string()), ("index", pa.int64()), ("level", pa.int32()), ("digest", pa.string())])

    def task(batches):
        out = []
        for _, block in _blocks(batches, ["tree", "block", "index", "level", "digest"]):
            digests, _ = _lifted(block["index"], block["level"], block["digest"], base)
            up, root, _ = forward(digests)
            level = base + up if len(digests) > 1 or block["index"][0] else block["level"][0]
            out.append((block["tree"][0], block["block"][0], level, root))
            if len(out) >= FLUSH_ROWS:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    return _sorted(nodes).mapInArrow(task, NODE)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _sorted(nodes: DataFrame) -> DataFrame:
    """Nodes by block, each block's nodes in the order of their labels; a row with its root's path (index -1) first."""
    blocked = nodes if "block" in nodes.columns else nodes.withColumn("block", _block())
    return blocked.repartition("tree", "block").sortWithinPartitions("tree", "block", "index")


def _block() -> Column:
    return F.expr(f"index div {ARITY**LEVELS}")


def _rounds(nodes: DataFrame, tables: Tables) -> list[DataFrame]:
    """The nodes of each round up to the one in which every tree is a single node."""
    rounds = [nodes]
    while (nodes.agg(F.max("index")).first()[0] or 0) > 0:
        nodes = tables.settle(_climb(nodes.select("tree", "index", "level", "digest"), len(rounds) - 1))
        rounds.append(nodes)
    return rounds


def _descend(nodes: DataFrame, roots: DataFrame, done: int, kept: Sequence[str]) -> DataFrame:
    """(columns of `kept`, path, subroot): nodes of a round with the paths that their blocks' roots hand down."""
    base = done * LEVELS
    above = roots.select("tree", F.col("index").alias("block"), F.lit(-1).cast("long").alias("index"), "path", "subroot")
    both = _sorted(nodes.withColumn("block", _block()).unionByName(above, allowMissingColumns=True))
    columns = list(dict.fromkeys(["tree", "block", "index", "level", "digest", "path", "subroot", *kept]))
    wanted = [*kept, "path", "subroot"]

    def task(batches):
        out: list[tuple] = []
        schema = None
        for seen, block in _blocks(batches, columns):
            schema = schema or pa.schema([seen.field(name) for name in wanted])
            digests, lifts = _lifted(block["index"][1:], block["level"][1:], block["digest"][1:], base)
            up, _, runs = forward(digests)
            paths = backward(runs, up, block["path"][0])
            kept_rows = zip(*(block[name][1:] for name in kept))
            out += [(*row, "*/" * lifts[at] + paths[at], block["subroot"][0]) for at, row in enumerate(kept_rows)]
            if len(out) >= FLUSH_ROWS:
                yield _batch(out, schema)
                out = []
        if out:
            yield _batch(out, schema)

    both = both.select(*columns)
    return both.mapInArrow(task, both.select(*wanted).schema)


def manifest(
    docs: DataFrame,
    fields: Mapping[str, Column] | None = None,
    group: str = "source",
    order: str = "doc_id",
    carried: Mapping[str, Column] | None = None,
) -> DataFrame:
    """(group, order, leaf, the columns of `carried`, path, subroot, root): every row of `docs` with its proof.

    `leaf` is the digest of `fields` (name to value; those of `documents` if not given). In its group's tree a row's
    place follows `order`, nulls first; rows alike in it are placed by their digests. Groups, null
    first, then by UTF-8 bytes, are the leaves of the tree above, whose root is the same in every row.
    `path` holds a step per level, as `folded` takes them. Columns of `carried` are computed with the leaf.

    Other columns don't matter, whatever their names. Texts are read once, whole, and don't move. Repeated rows are
    leaves each, with proofs of their own. Null and empty values differ. An empty table has no rows.
    """
    tables = Tables(docs.sparkSession, "merkle")
    values = fields if fields is not None else {name: F.col(name) for name in FIELDS}
    extra = dict(carried or {})
    names = [f"carried_{k}" for k in range(len(extra))]
    leaves = tables.settle(
        docs.select(
            # A null group's tree sorts before all others.
            F.when(F.col(group).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group).cast("string"))).alias("tree"),
            F.col(group).alias("in_group"), F.col(order).alias("in_order"), leaf(list(values.values())).alias("digest"),
            *(column.alias(name) for name, column in zip(names, extra.values())),
        )
    )
    by = [F.col("in_order").asc_nulls_first(), F.col("digest")]
    numbered = places(leaves, "tree", by, tables).withColumn("level", F.lit(0)).drop("total")
    rounds = _rounds(numbered, tables)
    subroots = rounds[-1]

    above = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.lit(0).alias("level"), "digest")
    above = places(above, "tree", [F.col("of")], tables).drop("total")
    upper = _rounds(above, tables)
    top = upper[-1].first()
    root = top["digest"] if top else None

    paths = upper[-1].select("tree", "index", F.lit("").alias("path"), F.col("digest").alias("subroot"))
    for done in range(len(upper) - 1, 0, -1):
        paths = tables.settle(_descend(upper[done], paths, done, ["tree", "index"]))
    paths = _descend(upper[0], paths, 0, ["of", "digest"])
    paths = paths.select(F.col("of").alias("tree"), F.lit(0).cast("long").alias("index"), "path", F.col("digest").alias("subroot"))
    paths = tables.settle(paths)
    for done in range(len(rounds) - 1, 0, -1):
        paths = tables.settle(_descend(rounds[done], paths, done, ["tree", "index"]))
    proofs = _descend(rounds[0], paths, 0, ["in_group", "in_order", "digest", *names])
    return proofs.select(
        F.col("in_group").alias(group), F.col("in_order").alias(order), F.col("digest").alias("leaf"),
        *(F.col(name).alias(key) for name, key in zip(names, extra)), "path", "subroot", F.lit(root).cast("string").alias("root"),
    )


def siblings(path: Column) -> Column:
    """The digests of a proof, from the leaf's run up to the root's, one after the other."""
    return F.translate(path, "*/", "")


def folded(value: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and a path; equal to the manifest's if the leaf is unchanged."""
    steps = F.filter(F.split(path, "/"), lambda step: step != "")
    return F.aggregate(steps, value, lambda below, step: F.sha2(F.replace(step, F.lit("*"), below), 256))
