"""Similarity self-join of documents on their word n-grams: rare-first prefixes, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetime.llm.components import components
from placetime.llm.tables import Tables
from placetime.llm.words import BLANK, U64, mix, shingles, slices, words

#: The counts that order n-grams: 2^SKETCH_BITS sums over all documents, shuffled in pieces.
SKETCH_BITS = 20
PIECE_BITS = 14
#: Documents of one key go to blocks of about so many n-grams; a task holds two blocks.
BLOCK_NGRAMS = 1 << 18
#: The suffix filter counts a set's n-grams by so many ranges of their hashes; its finer form has
#: ranges of about so many n-grams.
RANGES = 16
FINE_NGRAMS = 8


def need(n: Column | np.ndarray, m, percent: int):
    """The least overlap of two sets of n and m with a Jaccard similarity of `percent` or more."""
    return -(-percent * (n + m) // (100 + percent))


def _sets(batch_column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct n-grams of each text as sorted hashes."""
    for lo, hi, data, offsets in slices(batch_column):
        found = words(data, offsets, BLANK)
        for i in range(hi - lo):
            yield np.unique(shingles(found.hashes[found.bounds[i] : found.bounds[i + 1]], size))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def profile(docs: DataFrame, size: int) -> DataFrame:
    """Per document its set's size and 128-bit fingerprint; per task the counts of n-grams by bucket.

    One pass gives both kinds of rows (`piece` is null in the first kind), so texts are read once.
    """
    schema = "doc_id long, n long, fp1 long, fp2 long, piece int, counts binary"
    kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("piece", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            out = []
            for grams in _sets(batch.column(1), size):
                # A batch's buckets are summed document by document: no list grows with the task.
                np.add.at(sketch, (grams >> U64(64 - SKETCH_BITS)).astype(np.int64), 1)
                out.append((len(grams), *_fingerprint(grams)))
            columns = list(zip(*out)) if out else [[]] * 3
            none = pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), *none], schema=kinds
            )
        pieces = sketch.reshape(-1, 1 << PIECE_BITS)
        used = np.flatnonzero(pieces.any(axis=1)).tolist()
        empty = [pa.nulls(len(used), pa.int64())] * 4
        # Only the order follows from the counts, so a task may cut them off.
        counts = pa.array([np.minimum(pieces[i], 65535).astype("<u2").tobytes() for i in used], pa.binary())
        yield pa.RecordBatch.from_arrays([*empty, pa.array(used, pa.int32()), counts], schema=kinds)

    return docs.mapInArrow(run, schema)


def frequencies(profiled: DataFrame) -> np.ndarray:
    """How often n-grams of each bucket occur: 2^SKETCH_BITS numbers, whatever the input's size."""

    def total(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(1 << PIECE_BITS, np.int64)
        for part in group["counts"]:
            counts += np.frombuffer(part, "<u2")
        return pd.DataFrame({"piece": [key[0]], "counts": [counts.tobytes()]})

    rows = (
        profiled.filter("piece is not null").select("piece", "counts").groupBy("piece").applyInPandas(total, "piece int, counts binary")
    ).collect()  # 2^(SKETCH_BITS - PIECE_BITS) rows
    out = np.zeros((1 << (SKETCH_BITS - PIECE_BITS), 1 << PIECE_BITS), np.int64)
    for row in rows:
        out[row["piece"]] = np.frombuffer(row["counts"], np.int64)
    return out.ravel()


def prefixes(docs: DataFrame, counts: np.ndarray, size: int, percent: int) -> DataFrame:
    """Per document fp1, fp2, n, its prefix in rare-first order, and for the suffix filter the
    number of n-grams in each range of hashes, coarse and fine. Documents without n-grams are left out."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    schema = "doc_id long, n long, fp1 long, fp2 long, prefix array<long>, ranges binary, fine binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            out, at, ids = [], 0, []
            for grams in _sets(batch.column(1), size):
                n = len(grams)
                if n:
                    ids.append(at)
                    length = n - -(-percent * n // 100) + 1
                    order = np.lexsort((grams, counts[(grams >> U64(64 - SKETCH_BITS)).astype(np.int64)]))
                    ranges, fine = _by_range(grams, RANGES).astype("<u4"), fine_ranges(grams)
                    out.append((n, *_fingerprint(grams), _signed(grams[order[:length]]), ranges.tobytes(), fine.tobytes()))
                at += 1
            columns = list(zip(*out)) if out else [[]] * 6
            whole = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, whole)),
                 *(pa.array(c, t) for c, t in zip(columns, (whole, whole, whole, pa.list_(whole), pa.binary(), pa.binary())))],
                names=["doc_id", "n", "fp1", "fp2", "prefix", "ranges", "fine"],
            )

    return docs.mapInArrow(run, schema)


def _by_range(grams: np.ndarray, parts: int) -> np.ndarray:
    return np.bincount((grams & U64(parts - 1)).astype(np.int64), minlength=parts)


def fine_ranges(grams: np.ndarray) -> np.ndarray:
    """The number of n-grams in each of about n / FINE_NGRAMS ranges, a byte each."""
    parts = 1 << max(1, (len(grams) // FINE_NGRAMS).bit_length())
    while (counts := _by_range(grams, parts)).max() > 255:
        parts *= 2
    return counts.astype(np.uint8)


def most_common(one: np.ndarray, other: np.ndarray) -> int:
    """No two sets with these fine ranges have more n-grams in common."""
    few, many = sorted((one, other), key=len)
    return int(np.minimum(few, many.reshape(-1, len(few)).sum(axis=0, dtype=np.int64)).sum())


GROUP = ["key", "first", "second"]


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by group, regrouped so that no group is torn; a group is two blocks at most."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        groups = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in GROUP])
        last = np.flatnonzero((groups[:, 1:] != groups[:, :-1]).any(axis=0))
        if held:
            before = [held[-1].column(c)[-1].as_py() for c in GROUP]
            if before != groups[:, 0].tolist():
                yield pa.Table.from_batches(held)
                held = []
        if len(last):
            cut = int(last[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _pairs(rows: pa.Table, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of two rows of one group that may be similar, by length, by the place of the key
    they share, and by the counts in ranges of hashes; the key must be the first that both
    prefixes hold, so no pair comes up under two keys. Without the columns for the last tests, pairs
    pass that may fail them."""
    key, first, second, block, n, at = (rows.column(c).to_numpy() for c in (*GROUP, "block", "n", "at"))
    given = set(rows.column_names)
    if "ranges" in given:
        ranges = np.frombuffer(b"".join(rows.column("ranges").to_pylist()), "<u4").reshape(-1, RANGES)
    if "earlier" in given:
        earlier = [frozenset(p) for p in rows.column("earlier").to_pylist()]
    if "fine" in given:
        fine = [np.frombuffer(f, np.uint8) for f in rows.column("fine").to_pylist()]

    apart, near = 1, np.arange(len(key))
    while True:
        # All rows against the row so many places further on, as long as that is in the same group.
        near = near[near + apart < len(key)]
        there = near + apart
        near = near[(key[near] == key[there]) & (first[near] == first[there]) & (second[near] == second[there])]
        if not len(near):
            return
        i, j = near, near + apart
        least = need(n[i], n[j], percent)
        fits = (np.minimum(n[i] - at[i], n[j] - at[j]) >= least) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        fits &= (block[i] != block[j]) | (first[i] == second[i])
        i, j, least = i[fits], j[fits], least[fits]
        if len(i) and "ranges" in given:
            fits = np.minimum(ranges[i], ranges[j]).sum(axis=1) >= least
            i, j, least = i[fits], j[fits], least[fits]
        if len(i) and "earlier" in given:
            fits = np.array([earlier[x].isdisjoint(earlier[y]) for x, y in zip(i.tolist(), j.tolist())], bool)
            i, j, least = i[fits], j[fits], least[fits]
        if len(i) and "fine" in given:
            fits = np.array([most_common(fine[x], fine[y]) >= m for x, y, m in zip(i.tolist(), j.tolist(), least.tolist())], bool)
            i, j = i[fits], j[fits]
        if len(i):
            yield i, j
        apart += 1


def _active(percent: int):
    """Of sorted groups, the rows with a partner left after the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            seen = np.zeros(rows.num_rows, bool)
            for i, j in _pairs(rows, percent):
                seen[i] = seen[j] = True
            yield from rows.filter(pa.array(seen)).combine_chunks().to_batches()

    return run


def _links(percent: int):
    """Of sorted groups, every pair that the filters leave is verified. Rows are (document, least document
    that it hangs together with here, null) and (document, itself, rows that it links with here), so
    a group of n similar documents gives 2n - 1 rows, whatever the number of its links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _whole_groups(batches):
            docs = rows.column("doc_id").to_numpy()
            grams = [np.frombuffer(g, U64) for g in rows.column("grams").to_pylist()]
            copies = rows.column("copies").to_numpy()
            n_links = np.zeros(len(docs), np.int64)
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.get(x, x) != x:
                    parent[x] = x = parent.get(parent[x], parent[x])
                return x

            for some, others in _pairs(rows, percent):
                for i, j in zip(some.tolist(), others.tolist()):
                    if not similar(grams[i], grams[j], percent):
                        continue
                    n_links[i] += copies[j]
                    n_links[j] += copies[i]
                    low, high = sorted((root(int(docs[i])), root(int(docs[j]))))
                    if low != high:
                        parent[high] = low
            found = [(x, root(x), None) for x in parent if root(x) != x]
            found += [(int(docs[i]), int(docs[i]), int(n_links[i])) for i in np.flatnonzero(n_links)]
            columns = [pa.array([row[k] for row in found], pa.int64()) for k in (0, 1, 2)]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n_links"])

    return run


def similar(one: np.ndarray, other: np.ndarray, percent: int) -> bool:
    """Exactly: is the Jaccard similarity of two sorted sets `percent` or more?"""
    if not len(one) or not len(other):
        return False
    at = np.searchsorted(other, one)
    at[at == len(other)] = 0
    common = int((other[at] == one).sum())
    return 100 * common >= percent * (len(one) + len(other) - common)


def _sorted_groups(df: DataFrame) -> DataFrame:
    return df.repartition(*GROUP).sortWithinPartitions(*GROUP)


def _fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    prints = np.array([grams.sum(dtype=U64), mix(grams ^ U64(0x5BD1E995)).sum(dtype=U64)], U64)
    return tuple(_signed(prints).tolist())


def _gram_sets(docs: DataFrame, size: int) -> DataFrame:
    """Per document its set, as sorted hashes, and the set's fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(*_fingerprint(grams), grams.tobytes()) for grams in _sets(batch.column(1), size)]
            columns = list(zip(*out)) if out else [[]] * 3
            kinds = (pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "fp1", "fp2", "grams"])

    return docs.mapInArrow(run, "doc_id long, fp1 long, fp2 long, grams binary")


def jaccard_components(
    docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of `docs`: id, n_shingles (size of its set), component_id and n_links, the number of other
    rows that it links with.

    A document's set holds the distinct runs of `size` words (of non-blank characters, A-Z as a-z)
    of its whole text; a shorter text is one run. Two documents link when the Jaccard similarity
    of their sets is at least `percent` / 100; component_id is the smallest id reachable by links,
    its own included. Hashes of 64 bits stand for n-grams.

    * Equal sets are one class, found by a 128-bit fingerprint and represented by its least id, so
      copies never meet in a group.
    * N-grams are ordered rare first by counts over all documents. A pair that is similar shares an
      n-gram of both prefixes (what may be missing of a set, plus one), so classes are grouped by each
      n-gram of their prefixes. N-grams in one prefix only are dropped by a count that precedes.
    * A crowded n-gram is cut into blocks and its pairs of blocks go to different tasks. Within a
      task, pairs are filtered by length, by the place of the first n-gram they share and by the
      counts of n-grams in ranges of hashes, first few and then fine ones; pairs are never emitted as rows.
    * Only documents with a partner left are read again for their sets, and each such pair is
      verified once, under the first n-gram that both prefixes share. Links are summed per class
      in the task, each weighed by the rows of the class at its other end.

    Null and empty texts and texts of blanks have an empty set and link with nothing. Rows without
    an id keep their size, get a null component and link with nothing. Repeated rows are rows of their own. Repeated ids with
    different texts: each row links by its own text, and the id ties no rows. Other columns
    don't matter. An empty table gives no rows.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "ngram-join")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    profiled = tables.settle(profile(texts, size))
    rows = profiled.filter("piece is null").select("doc_id", "n", "fp1", "fp2")
    classes = tables.settle(
        rows.filter("n > 0 and doc_id is not null").groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    counts = frequencies(profiled)

    # One row per class: the row of its representative.
    reps = classes.select(F.col("rep").alias("doc_id"), "fp1", "fp2", "copies")
    found = prefixes(texts.filter("doc_id is not null"), counts, size, percent)
    heads = tables.settle(found.join(reps, ["doc_id", "fp1", "fp2"]).dropDuplicates(["doc_id", "fp1", "fp2"]))
    node = F.xxhash64("doc_id", "fp1", "fp2")  # a class; ids may repeat

    shared = tables.settle(
        heads.select(F.explode("prefix").alias("key"), "n")
        .groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("ngrams"))
        .filter("m > 1").select("key", F.ceil(F.col("ngrams") / BLOCK_NGRAMS).cast("int").alias("blocks"))
    )
    # Rows stay narrow until only n-grams of several prefixes are left.
    narrow = heads.select(node.alias("doc_id"), "n", F.posexplode("prefix").alias("at", "key"))
    spots = tables.settle(narrow.join(shared, "key"))
    spread = spots.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = spread.select(
        "key", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block", "doc_id", "n", "at"
    )
    near = tables.settle(_sorted_groups(pairs).mapInArrow(_active(percent), pairs.schema))
    tables.drop(shared, spots)

    def narrowed(rows: DataFrame, column: str) -> DataFrame:
        """A column of the heads that `rows` ask for; while these are few, the others don't move."""
        asked = tables.settle(rows.select("doc_id").distinct())
        return heads.select(node.alias("doc_id"), column).join(asked, "doc_id", "left_semi")

    full = near.join(narrowed(near, "ranges"), "doc_id")
    fitting = tables.settle(_sorted_groups(full).mapInArrow(_active(percent), full.schema))
    full = fitting.join(narrowed(fitting, "prefix"), "doc_id")
    full = full.withColumn("earlier", F.expr("slice(prefix, 1, at)")).drop("prefix")
    unseen = tables.settle(_sorted_groups(full).mapInArrow(_active(percent), full.schema))
    tables.drop(near, fitting)
    full = unseen.join(narrowed(unseen, "fine"), "doc_id")
    active = tables.settle(_sorted_groups(full).mapInArrow(_active(percent), full.schema))

    wanted = active.select(F.col("doc_id").alias("node")).distinct()
    again = tables.settle(heads.select(node.alias("node"), "doc_id", "fp1", "fp2", "copies").join(wanted, "node", "left_semi"))
    # Of rows that repeat an id, only the one with the class's text gives the class's set.
    read = _gram_sets(texts.join(again.select("doc_id"), "doc_id", "left_semi"), size)
    # Sets move once by node, for repeated rows and for the join, and once to their groups.
    sets = read.join(again, ["doc_id", "fp1", "fp2"]).select(F.col("node").alias("doc_id"), "grams", "copies")
    candidates = active.join(sets.dropDuplicates(["doc_id"]), "doc_id")
    verified = _sorted_groups(candidates).mapInArrow(_links(percent), "a long, b long, n_links long")
    edges = tables.settle(verified)
    linked = components(edges.select("a", "b"), tables)
    summed = edges.filter("n_links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n_links").alias("links"))

    # From nodes back to the smallest id: a component's name is the least representative in it.
    members = heads.select(node.alias("node"), F.col("doc_id").alias("rep"), "fp1", "fp2")
    joined = tables.settle(members.join(linked, "node").join(summed, "node"))
    named = joined.join(joined.groupBy("component").agg(F.min("rep").alias("least")), "component")
    final = tables.settle(
        classes.join(named.select("fp1", "fp2", "least", "links"), ["fp1", "fp2"], "left").select(
            "fp1", "fp2", F.coalesce("least", "rep").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    tables.drop(heads, unseen, active, again, edges, joined)
    out = rows.join(final, ["fp1", "fp2"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    links = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), 0).otherwise(F.col("n_links")).cast("long")
    return out.select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), links.alias("n_links"))

