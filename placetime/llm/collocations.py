"""Phrases whose words belong together, per language, by best-first branch and bound.

The tree of phrases grows by words at the end: a node is a phrase, its branch all phrases that begin with
it. Cutting after the first word shows that no phrase of a branch scores above 1000 n / f(first word), as
the whole is no more frequent than the rest. So branches are expanded from the rarest first word on, until the
bound of all others is below the score that the last wanted phrase has already.

Each expansion passes over the texts for counts, as the frontier may be anything: words and phrases travel as
64-bit hashes of words, one or a few numbers per distinct phrase and slice of text. Frontiers are handed to
tasks as bitmaps of a fixed size; what they let through too much is dropped by exact joins afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placetime.llm.tables import Tables
from placetime.llm.words import BLANK, LOWER, U64, mix, slices, text_hash, words

#: Bytes that end a piece of text, and those that only stand between words.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BETWEEN = PIECE_END | BLANK

#: Bits of a bitmap (4 MB); each is broadcast.
BITS = 1 << 25
#: Most words of a phrase.
LONGEST = 5
H = [f"h{k + 1}" for k in range(LONGEST)]
_SPREAD = np.random.default_rng(77).integers(0, 2**63, LONGEST, dtype=U64) * U64(2) + U64(1)


class Tokens:
    """The words of a slice of texts: hashes (with the language), and which of them are followed by one of the same piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, seeds: np.ndarray):
        found = words(data, offsets, BETWEEN)
        self.starts, self.ends = found.starts, found.ends
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(found.bounds))
        hashes = mix(found.hashes ^ seeds[self.text])
        hashes[hashes == 0] = 1  # 0 is no word
        self.n = len(hashes)
        self.hashes = np.concatenate([hashes, np.zeros(LONGEST, U64)])
        piece = np.cumsum(PIECE_END[data])[self.starts] if self.n else self.starts
        self.joined = np.zeros(self.n + LONGEST, bool)
        if self.n > 1:
            self.joined[: self.n - 1] = (piece[1:] == piece[:-1]) & (self.text[1:] == self.text[:-1])

    def slot(self, size: int) -> np.ndarray:
        """The bitmap slot of the phrase of `size` words at each place."""
        key = self.hashes[: self.n].copy()
        for k in range(1, size):
            key ^= self.hashes[k : self.n + k] >> U64(9 * k)
        return (key & U64(BITS - 1)).astype(np.int64)

    def grouped(self, at: np.ndarray, size: int, sides: bool) -> list[np.ndarray]:
        """Distinct phrases of `size` words at the places `at`: their words' hashes, counts and, with `sides`, the word
        before and the word after where it is always the same one, else 0."""
        key = np.zeros(len(at), U64)
        for k in range(size):
            key += self.hashes[at + k] * _SPREAD[k]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(at) else np.zeros(0, np.int64)
        counts = np.diff(np.append(first, len(at)))
        at = at[order]
        out = [self.hashes[at[first] + k] for k in range(size)] + [counts]
        if sides and len(at):
            before = np.where((at > 0) & self.joined[at - 1], self.hashes[at - 1], U64(0))
            after = np.where(self.joined[at + size - 1], self.hashes[at + size], U64(0))
            for side in (before, after):
                least, most = np.minimum.reduceat(side, first), np.maximum.reduceat(side, first)
                out.append(np.where(least == most, least, U64(0)))
        elif sides:
            out += [np.zeros(0, U64)] * 2
        return out


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Tokens, np.ndarray, list[str]]]:
    """Each slice's tokens, its lower-case bytes and its texts' languages."""
    seeds: dict[str, int] = {}
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        for lang in set(langs) - seeds.keys():
            seeds[lang] = text_hash(f"lang {lang}")
        for first, end, data, offsets in slices(batch.column("text")):
            own = langs[first:end]
            yield Tokens(data, offsets, np.array([seeds[lang] for lang in own], U64)), LOWER[data], own


def _batch(names: Sequence[str], columns: Sequence) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, list(names))


def _count_words(batches):
    for tokens, data, langs in _sliced(batches):
        own = tokens.hashes[: tokens.n]
        found, at, counts = np.unique(own, return_index=True, return_counts=True)
        text = data.tobytes()
        spelled = [text[a:b].decode() for a, b in zip(tokens.starts[at].tolist(), tokens.ends[at].tolist())]
        spoken = [langs[t] for t in tokens.text[at].tolist()]
        yield _batch(["h", "lang", "word", "f"], [found, pa.array(spoken, pa.string()), pa.array(spelled, pa.string()), counts])


def _has(bits, slots: np.ndarray) -> np.ndarray:
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & np.uint8(1) == 1


class Bitmap:
    """A set of phrases as bits, broadcast to tasks."""

    def __init__(self, spark: SparkSession, bits: np.ndarray):
        self.bits, self.spark = bits, spark
        self.sent = spark.sparkContext.broadcast(bits)

    @classmethod
    def of(cls, rows: DataFrame, columns: Sequence[str]) -> Bitmap:
        """Of the phrases whose words' hashes are in `columns` (0: no word). At most BITS / 64 numbers are collected."""
        key = F.col(columns[0])
        for k, column in enumerate(columns[1:], 1):
            key = key.bitwiseXOR(F.shiftrightunsigned(column, 9 * k))
        slots = rows.select(key.bitwiseAND(F.lit(BITS - 1)).alias("slot"))
        filled = slots.groupBy(F.expr("slot div 64").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits"))
        got = filled.toPandas()
        bits = np.zeros(BITS // 64, np.int64)
        bits[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64)
        return cls(rows.sparkSession, bits.view(np.uint8))

    def with_all(self, other: Bitmap | None) -> Bitmap:
        return self if other is None else Bitmap(self.spark, self.bits | other.bits)


def _count_pairs(first: Bitmap, frequent: Bitmap):
    """Counts of pairs of words whose first one is to be expanded and whose second one is frequent."""
    firsts, others = first.sent, frequent.sent

    def task(batches):
        for tokens, _, _ in _sliced(batches):
            slot = tokens.slot(1)
            second = np.append(_has(others.value, slot)[1:], False) if tokens.n else np.zeros(0, bool)
            at = np.flatnonzero(_has(firsts.value, slot) & second & tokens.joined[: tokens.n])
            yield _batch(["h1", "h2", "n"], tokens.grouped(at, 2, sides=False))

    return task


def _count_phrases(first: Bitmap, known: Bitmap, pairs: Bitmap, frequent: Bitmap):
    """Counts and sides of phrases whose first word is to be expanded and which hold no pair known to be rare.

    A pair is known to be rare if its first word has been expanded (`known`) and it isn't among `pairs`.
    """
    firsts, expanded, found, others = first.sent, known.sent, pairs.sent, frequent.sent

    def task(batches):
        for tokens, _, _ in _sliced(batches):
            slot = tokens.slot(1)
            second = np.append(_has(others.value, slot)[1:], False) if tokens.n else np.zeros(0, bool)
            maybe = tokens.joined[: tokens.n] & second
            maybe &= ~_has(expanded.value, slot) | _has(found.value, tokens.slot(2))
            grows = np.append(maybe, np.zeros(LONGEST, bool))
            at = np.flatnonzero(_has(firsts.value, slot) & maybe)
            for size in range(2, LONGEST + 1):
                if size > 2:
                    at = at[grows[at + size - 2]]
                *hashes, n, before, after = tokens.grouped(at, size, sides=True)
                absent = [np.zeros(len(n), np.int64)] * (LONGEST - size)
                yield _batch([*H, "n", "before", "after"], [*hashes, *absent, n, before, after])

    return task


def _count_rests(wanted: Bitmap):
    """Counts of phrases of two to four words that are asked for."""
    asked = wanted.sent

    def task(batches):
        for tokens, _, _ in _sliced(batches):
            whole = np.ones(tokens.n, bool)
            for size in range(2, LONGEST):
                whole &= tokens.joined[size - 2 : size - 2 + tokens.n]
                at = np.flatnonzero(whole & _has(asked.value, tokens.slot(size)))
                *hashes, n = tokens.grouped(at, size, sides=False)
                absent = [np.zeros(len(n), np.int64)] * (LONGEST - 1 - size)
                yield _batch([*H[:-1], "n"], [*hashes, *absent, n])

    return task


def _phrase(columns: Sequence[str] = H) -> Column:
    return F.filter(F.array(*columns), lambda h: h != 0).alias("phrase")


def _longs(*names: str) -> str:
    return ", ".join(f"{name} long" for name in names)


def _exact(text: str) -> Column:
    """An expression of whole numbers beyond 64 bits: {name} becomes a column of up to 38 digits."""
    return F.expr(text.replace("{", "cast(").replace("}", " as decimal(19, 0))"))


def _first_by(rows: DataFrame, order: Sequence[Column], most: int) -> DataFrame:
    """Each language's first `most` rows with their `rank`; a language's rows are ranked in parts first."""
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    each = Window.partitionBy("lang", "part").orderBy(*order)
    rows = rows.withColumn("part", part).withColumn("rank", F.row_number().over(each)).filter(F.col("rank") <= most)
    whole = Window.partitionBy("lang").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(whole).cast("long")).filter(F.col("rank") <= most).drop("part")


def collocations(
    docs: DataFrame, min_count: int = 100, top: int = 2000, lang_col: str = "lang", text_col: str = "text", share: int = 8
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of two to five words that occur `min_count` times.

    Words are lower-case (A-Z) and lie between blanks in pieces that end at `.,;:!?` and line ends. With a, l and r the
    counts of the phrase and its two parts at a cut and n all words of the language, the cut scores
    floor(1000 a n / (l r)); the lowest cut counts, the first of several. A phrase goes if a longer one with
    it inside is as frequent. Ranks go by score, a (both descending) and phrase.

    A phrase goes exactly if all its places have the same word before them, or the same one after them:
    then the phrase longer by that word is as frequent; so that is seen while counting.

    The first frontier holds the rarest frequent words, a `share`-th of a language's text; the next one all words
    whose bound reaches the score found, or `share` times as much text if too few phrases were.

    A null language is "und", a null text empty; other columns don't matter. Repeated rows count each. Texts of any
    length are counted whole. Without a frequent phrase there are no rows. Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "collocations")
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counted = texts.mapInArrow(_count_words, "h long, lang string, word string, f long")
    vocabulary = tables.settle(counted.groupBy("lang", "word", "h").agg(F.sum("f").alias("f")))
    totals = tables.settle(vocabulary.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = tables.settle(vocabulary.filter(F.col("f") >= min_count).join(totals, "lang"))
    common = Bitmap.of(frequent, ["h"])

    # How far to go: the most frequent word to expand, per language.
    masses = frequent.groupBy("lang", "f", "n").agg(F.sum("f").alias("mass"))
    rising = Window.partitionBy("lang").orderBy("f").rowsBetween(Window.unboundedPreceding, -1)
    masses = tables.settle(masses.withColumn("rarer", F.coalesce(F.sum("mass").over(rising), F.lit(0))))

    def reach(parts: Column) -> DataFrame:
        """(lang, upto): words up to this frequency make up at least n / parts of the text, if so many are frequent."""
        return masses.filter(F.col("rarer") * parts <= F.col("n")).groupBy("lang").agg(F.max("f").alias("upto"))

    caps = tables.settle(reach(F.lit(share)).withColumn("done", F.lit(0).cast("long")).withColumn("least", F.lit(0).cast("long")))
    pairs = phrases = rests = None
    known: Bitmap | None = None
    found: Bitmap | None = None
    parts = share
    while True:
        new = tables.settle(frequent.join(caps, "lang").filter("f <= upto and f > done"))
        first = Bitmap.of(new, ["h"])
        known = first.with_all(known)
        near = texts.mapInArrow(_count_pairs(first, common), _longs("h1", "h2", "n")).groupBy("h1", "h2").agg(F.sum("n").alias("n"))
        pairs = tables.settle(near.filter(F.col("n") >= min_count))
        found = Bitmap.of(pairs, H[:2]).with_all(found)
        grown = texts.mapInArrow(_count_phrases(first, known, found, common), _longs(*H, "n", "before", "after"))
        both = [F.min("before").alias("b1"), F.max("before").alias("b2"), F.min("after").alias("a1"), F.max("after").alias("a2")]
        grown = grown.groupBy(*H).agg(F.sum("n").alias("a"), *both).filter(F.col("a") >= min_count)
        inside = (F.col("b1") == F.col("b2")) & (F.col("b1") != 0) | (F.col("a1") == F.col("a2")) & (F.col("a1") != 0)
        own = new.select(F.col("h").alias("h1"), "lang", "n", F.col("f").alias("f1"))
        grown = grown.join(own, "h1").select("lang", "n", *H, "a", "f1", ((F.col("h5") == 0) & inside).alias("dropped"))
        grown = tables.settle(grown)
        phrases = grown if phrases is None else phrases.unionAll(grown)

        survivors = _hopeful(phrases.filter(~F.col("dropped")), frequent, caps)
        survivors = tables.settle(survivors)
        expanded = frequent.join(caps, "lang").filter("f <= upto").select("h")
        rests = _rests(texts, survivors, expanded, rests, tables)
        scored = tables.settle(_scored(survivors, frequent, phrases, rests))
        last = _first_by(scored.select("lang", "phrase", "score"), [F.col("score").desc()], top).filter(F.col("rank") == top)
        parts = parts // share
        wider = masses.groupBy("lang").agg(F.max("f").alias("widest"), F.first("n").alias("n"))
        if parts > 1:
            wider = wider.drop("widest").join(reach(F.lit(parts)).withColumnRenamed("upto", "widest"), "lang")
        bound = _exact("(1000 * {n}) div {score}")
        after = (
            caps.select("lang", F.col("upto").alias("done")).join(wider, "lang").join(last.select("lang", "score"), "lang", "left")
            .withColumn("upto", F.greatest("done", F.when(F.col("score").isNull(), F.col("widest")).when(F.col("score") > 0, bound).otherwise(F.col("widest"))))
            .select("lang", "upto", "done", F.coalesce("score", F.lit(0)).cast("long").alias("least"))
        )
        after = tables.settle(after)
        waiting = frequent.join(after, "lang").filter("f > done and f <= upto")
        if waiting.isEmpty():
            caps = after
            break
        caps = after

    best = scored.join(caps.select("lang", "least"), "lang").filter(F.col("score") >= F.col("least")).drop("least")
    spelled = best.select("phrase", F.posexplode("phrase").alias("at", "h")).join(frequent.select("h", "word"), "h")
    spelled = spelled.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    told = best.join(spelled, "phrase").withColumn("phrase", F.array_join(F.col("words.word"), " "))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    return _first_by(told, order, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _hopeful(phrases: DataFrame, frequent: DataFrame, caps: DataFrame) -> DataFrame:
    """Phrases whose bound from their first and last word reaches the score that is needed, with `phrase`."""
    last = F.element_at("phrase", -1).alias("h")
    ends = phrases.select("lang", "n", "a", "f1", _phrase()).withColumn("h", last).join(frequent.select("h", F.col("f").alias("f2")), "h")
    ends = ends.join(caps.select("lang", "least"), "lang")
    return ends.filter(_exact("(1000 * {n}) div {greatest(f1, f2)}") >= F.col("least")).select("lang", "n", "a", "phrase")


def _rests(texts: DataFrame, survivors: DataFrame, expanded: DataFrame, before: DataFrame | None, tables: Tables) -> DataFrame:
    """(phrase, f) of what is left of survivors after a cut, where its first word was not expanded and so not counted."""
    cuts = survivors.filter(F.size("phrase") > 2).select("phrase", F.explode(F.expr("sequence(2, size(phrase) - 1)")).alias("k"))
    rest = cuts.select(F.expr("slice(phrase, k, size(phrase))").alias("phrase")).distinct()
    rest = rest.join(expanded.withColumnRenamed("h", "h1"), F.col("phrase")[0] == F.col("h1"), "left_anti")
    if before is not None:
        rest = rest.join(before, "phrase", "left_anti")
    padded = [F.coalesce(F.get("phrase", F.lit(k)), F.lit(0)).alias(name) for k, name in enumerate(H[:-1])]
    wanted = tables.settle(rest.select(*padded))
    if wanted.isEmpty():
        return before if before is not None else wanted.select(_phrase(H[:-1]), F.lit(0).cast("long").alias("f"))
    asked = Bitmap.of(wanted, H[:-1])
    counts = texts.mapInArrow(_count_rests(asked), _longs(*H[:-1], "n")).groupBy(*H[:-1]).agg(F.sum("n").alias("f"))
    counts = tables.settle(counts.join(wanted, H[:-1]).select(_phrase(H[:-1]), "f"))
    return counts if before is None else before.unionAll(counts)


def _scored(survivors: DataFrame, frequent: DataFrame, phrases: DataFrame, rests: DataFrame) -> DataFrame:
    """Survivors with l, r and score of their lowest cut."""
    counts = frequent.select(F.array("h").alias("phrase"), "f").unionAll(phrases.filter("h5 = 0").select(_phrase(), F.col("a").alias("f")))
    counts = counts.unionAll(rests.select("phrase", "f")).groupBy("phrase").agg(F.max("f").alias("f"))
    cuts = survivors.withColumn("k", F.explode(F.expr("sequence(1, size(phrase) - 1)")))
    cuts = cuts.withColumn("left", F.expr("slice(phrase, 1, k)")).withColumn("right", F.expr("slice(phrase, k + 1, size(phrase))"))
    cuts = cuts.join(counts.select(F.col("phrase").alias("left"), F.col("f").alias("l")), "left")
    cuts = cuts.join(counts.select(F.col("phrase").alias("right"), F.col("f").alias("r")), "right")
    score = _exact("(1000 * {a} * {n}) div ({l} * {r})").alias("score")
    lowest = cuts.select("lang", "n", "a", "phrase", F.struct(score, "k", "l", "r").alias("cut"))
    lowest = lowest.groupBy("lang", "n", "a", "phrase").agg(F.min("cut").alias("cut"))
    return lowest.select("lang", "n", "a", "phrase", "cut.l", "cut.r", "cut.score")
