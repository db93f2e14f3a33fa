"""Token counts that follow edits: a segment tree of pre-token runs per document, re-encoded only where edits fall.

A tree's leaves are runs of about `leaf_words` pre-tokens, cut where white space follows something
else: there the ids on both sides don't depend on each other. A leaf keeps how many characters and
tokens it has, an inner node the tokens below it, so the root holds the document's count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetime.llm.tables import Tables
from placetime.llm.tokenizing import PARTS, SPACE, ByteBpe

LEAF_WORDS = 64
_BLANK = re.compile(f"[{SPACE}]")


class Tree:
    """Token sums over the leaves of one document: `nodes[1]` is the root, leaves are at the end."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars = chars  # of each leaf
        self.width = 1 << max(0, int(len(chars) - 1).bit_length())
        self.nodes = np.zeros(2 * self.width, np.int64)
        self.nodes[self.width : self.width + len(tokens)] = tokens
        for start in _levels(self.width):
            below = self.nodes[2 * start : 4 * start]
            self.nodes[start : 2 * start] = below[::2] + below[1::2]

    @property
    def tokens(self) -> np.ndarray:
        return self.nodes[self.width : self.width + len(self.chars)]

    @property
    def total(self) -> int:
        return int(self.nodes[1])

    def update(self, leaf: int, tokens: int) -> None:
        """Sets a leaf's tokens and the sums on its way to the root."""
        at = self.width + leaf
        change = tokens - self.nodes[at]
        while at:
            self.nodes[at] += change
            at //= 2


def _levels(width: int) -> Iterator[int]:
    start = width // 2
    while start:
        yield start
        start //= 2


def leaves_of(text: str, leaf_words: int = LEAF_WORDS) -> list[str]:
    """A text cut into runs of `leaf_words` parts, at places where the ids don't depend on what follows."""
    parts = PARTS.findall(text)
    return ["".join(parts[i : i + leaf_words]) for i in range(0, len(parts), leaf_words)]


def build(text: str, encoder: ByteBpe, leaf_words: int = LEAF_WORDS) -> Tree:
    leaves = leaves_of(text, leaf_words)
    return Tree(np.array([len(x) for x in leaves], np.int64), np.array([len(encoder.ids(x)) for x in leaves], np.int64))


def edit(text: str, tree: Tree, edits: list[tuple[int, int, str]], encoder: ByteBpe, leaf_words: int = LEAF_WORDS) -> tuple[str, Tree, int]:
    """The text after the edits (start, end, replacement), its tree, and how many characters were encoded anew.

    Places count characters of the text as it was; edits are taken by start, and one that begins before
    an earlier one ends, or reaches beyond the text, is left out. Each edited region grows by whole
    leaves until the text around its two ends is cut safely, as boundary context; leaves outside
    keep their counts. Where a region keeps its number of leaves, the sums on the way to the root are updated;
    otherwise sums are added up anew from the leaves' counts, without encoding.
    """
    kept, upto = [], 0
    for start, end, new in sorted(edits):
        if upto <= start <= end <= len(text):
            kept.append((start, end, new))
            upto = end
    if not kept:
        return text, tree, 0
    if not text:
        after = "".join(new for _, _, new in kept)
        return after, build(after, encoder, leaf_words), len(after)
    ends = np.cumsum(tree.chars)
    begins = ends - tree.chars
    n = len(ends)
    first = np.minimum(np.searchsorted(ends, [e[0] for e in kept], "right"), n - 1)
    last = np.minimum(np.searchsorted(ends, [max(e[0], e[1] - 1) for e in kept], "right"), n - 1)
    touched = np.zeros(n, bool)
    for a, b in zip(first, last):
        touched[a : b + 1] = True
    grown = True
    while grown:
        grown, regions = False, []
        edges = np.flatnonzero(np.diff(np.concatenate([[False], touched, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # leaves a up to b
            low, high = int(begins[a]), int(ends[b - 1])
            fresh, at = [], low
            for k in np.flatnonzero((first >= a) & (first < b)).tolist():
                start, end, new = kept[k]
                fresh += [text[at:start], new]
                at = end
            fresh = "".join([*fresh, text[at:high]])
            before, after = text[low - 1 : low] if low else "", text[high : high + 1]
            if a > 0 and not _safe(before, fresh[:1] or after):
                touched[a - 1] = grown = True
            if b < n and not _safe(fresh[-1:] or before, after):
                touched[b] = grown = True
            regions.append((a, b, fresh))

    chars, tokens, pieces, encoded, at = [], [], [], 0, 0
    same_shape, updates = True, []
    for a, b, fresh in regions:
        leaves = leaves_of(fresh, leaf_words)
        counts = [len(encoder.ids(x)) for x in leaves]
        encoded += len(fresh)
        pieces += [text[int(begins[at]) : int(begins[a])] if at < n else "", fresh]
        chars += [*tree.chars[at:a].tolist(), *map(len, leaves)]
        tokens += [*tree.tokens[at:a].tolist(), *counts]
        same_shape &= len(leaves) == b - a
        updates += list(zip(range(a, b), counts))
        at = b
    pieces.append(text[int(begins[at]) :] if at < n else "")
    chars += tree.chars[at:].tolist()
    tokens += tree.tokens[at:].tolist()
    if same_shape:
        tree.chars = np.array(chars, np.int64)
        for leaf, count in updates:
            tree.update(leaf, count)
        return "".join(pieces), tree, encoded
    return "".join(pieces), Tree(np.array(chars, np.int64), np.array(tokens, np.int64)), encoded


def _safe(before: str, after: str) -> bool:
    """May a text be cut between these characters without changing its ids?"""
    return not before or not after or (not _BLANK.match(before) and bool(_BLANK.match(after)))


def build_trees(docs: DataFrame, tokenizer: str, leaf_words: int = LEAF_WORDS, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """(id, text_hash, n_tokens, chars, tokens): the tree of every whole text, its leaves' characters and tokens as
    32-bit numbers; the sums above follow from them. One pass without a shuffle. Null counts as empty, with 0 tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe(tokenizer, added_tokens)
        for batch in batches:
            out = []
            for text in batch.column(2):
                tree = build(text.as_py() or "", encoder, leaf_words)
                out.append((tree.total, tree.chars.astype("<u4").tobytes(), tree.tokens.astype("<u4").tobytes()))
            columns = list(zip(*out)) if out else [[]] * 3
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=[id_col, "text_hash", "n_tokens", "chars", "tokens"])

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, text_hash long, n_tokens long, chars binary, tokens binary"
    return docs.select(F.col(id_col), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col)).mapInArrow(run, schema)


def apply_edits(
    docs: DataFrame, trees: DataFrame, edits: DataFrame, tokenizer: str, leaf_words: int = LEAF_WORDS, id_col: str = "doc_id", text_col: str = "text",
    added_tokens: bool = False,
) -> DataFrame:
    """Documents that `edits` (id, text_hash, start, end, replacement) change, with their trees after the edits.

    Returns id, text_hash (of the text as it was), text (as it is now), n_edits, n_tokens, chars, tokens and
    encoded_chars, the characters that had to be encoded anew. Edits name a document by id and hash of
    its text, so rows that share an id are told apart, and rows alike are edited alike, once. Only
    documents with edits meet their trees; all edits of a document come together, as they bound its size.
    A null replacement deletes; edits with null places, of unknown documents or of rows without an id do nothing.
    """
    given = edits.filter(F.col("start").isNotNull() & F.col("end").isNotNull()).groupBy(id_col, "text_hash").agg(
        F.collect_list(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.coalesce("replacement", F.lit("")).alias("replacement"))).alias("edits")
    )
    texts = docs.select(F.col(id_col), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("_text"))
    keys = [id_col, "text_hash"]
    joined = given.join(texts, keys).dropDuplicates(keys).join(trees.dropDuplicates(keys).select(*keys, "chars", "tokens"), keys)
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
    names = ["text", "n_edits", "n_tokens", "chars", "tokens", "encoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe(tokenizer, added_tokens)
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                text, changes, chars, tokens = (batch.column(c)[i].as_py() for c in range(2, 6))
                tree = Tree(*(np.frombuffer(x, "<u4").astype(np.int64) for x in (chars, tokens)))
                changes = [(c["start"], c["end"], c["replacement"]) for c in changes]
                after, tree, encoded = edit(text or "", tree, changes, encoder, leaf_words)
                out.append((after, len(changes), tree.total, tree.chars.astype("<u4").tobytes(), tree.tokens.astype("<u4").tobytes(), encoded))
            columns = list(zip(*out)) if out else [[]] * 6
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=[*keys, *names])

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, text_hash long, text string, n_edits long, n_tokens long, chars binary, tokens binary, encoded_chars long"
    return joined.select(*keys, "_text", "edits", "chars", "tokens").mapInArrow(run, schema)


#: What cleaning replaces: mail addresses and long numbers.
PERSONAL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\+?\d[\d() -]{7,}\d")


def cleaning_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, start, end, replacement): the edits of a usual cleaning. Mail addresses and long
    numbers are replaced by a tag, and a line of two or more words that equals an earlier one of the text goes, with its end."""

    def found(text: str) -> list[tuple[int, int, str]]:
        out, seen, at = [], set(), 0
        for line in text.split("\n"):
            end = at + len(line)
            if line in seen:
                out.append((max(at - 1, 0), end, ""))
            elif line.count(" "):
                seen.add(line)
            at = end + 1
        gone = iter(sorted(out) + [(len(text) + 1, 0, "")])
        start, stop, _ = next(gone)
        for match in PERSONAL.finditer(text):
            while stop and stop <= match.start():
                start, stop, _ = next(gone)
            if match.end() <= start:
                out.append((match.start(), match.end(), "<mail>" if "@" in match[0] else "<number>"))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, edits = [], []
            for i in range(batch.num_rows):
                more = found(batch.column(2)[i].as_py() or "")
                edits += more
                rows += [i] * len(more)
            at = pa.array(rows, pa.int64())
            columns = list(zip(*edits)) if edits else [[]] * 3
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *arrays], names=[id_col, "text_hash", "start", "end", "replacement"])

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, text_hash long, start long, end long, replacement string"
    return docs.select(F.col(id_col), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col)).mapInArrow(run, schema)


def recounted(docs: DataFrame, edits: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", added_tokens: bool = False) -> DataFrame:
    """Per row of `docs`: id, n_tokens, n_edits, n_tokens_after and encoded_chars.

    Counts every whole text once, as a tree, and after the edits again from the trees. Rows without
    edits keep their count; null and empty texts have 0 tokens; rows without an id take no edits.
    Repeated rows give a row each. Other columns don't matter. An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "token-counts")
    trees = tables.settle(build_trees(docs, tokenizer, id_col=id_col, text_col=text_col, added_tokens=added_tokens))
    edits = tables.settle(edits)
    changed = apply_edits(docs, trees, edits, tokenizer, id_col=id_col, text_col=text_col, added_tokens=added_tokens)
    changed = tables.settle(
        changed.select(F.col(id_col).alias("_d"), F.col("text_hash").alias("_t"), "n_edits", F.col("n_tokens").alias("_after"), "encoded_chars")
    )
    tables.drop(edits)
    both = trees.join(changed, (F.col(id_col) == F.col("_d")) & (F.col("text_hash") == F.col("_t")), "left")
    zero = F.lit(0).cast("long")
    return both.select(
        id_col, "n_tokens", F.coalesce("n_edits", zero).alias("n_edits"), F.coalesce("_after", "n_tokens").alias("n_tokens_after"),
        F.coalesce("encoded_chars", zero).alias("encoded_chars"),
    )
