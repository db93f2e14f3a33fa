"""Toxicity by a weighted pattern grammar: transducers tag words, composed they score clauses.

Five transducers read a clause word by word, composed into one (see `transducers`). The insult and threat
transducers say which words match, the target transducer tells whether they point at someone, the negation
and reported-speech transducers weaken what they govern. Seed words are given; what insults cost, and insults and stems that the
seeds lack, are learned from labelled documents.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetime.llm import transducers
from placetime.llm.tables import Tables
from placetime.llm.words import NOT_ALNUM, U64, span_hashes, slices, text_hash, words

# Seeds of the grammar: common words, in natural order per language.
INSULTS = (
    "idiot moron loser scum trash stupid pathetic worthless disgusting dumb jerk bastard imbecile vermin filth"
    " idiotin trottel abschaum arschloch versager dummkopf"
    " imbécile connard salaud crétin ordure abruti"
    " idiota imbécil estúpido basura cabrón escoria"
).split()
THREATS = "kill murder hurt destroy shoot stab hang burn töten umbringen tuer frapper matar golpear".split()
INTENTS = "will gonna shall must should werde wird vais va voy vamos".split()
TARGETS = (
    "you your yours he him she her they them these those people everyone du dich dein sie ihr euch"
    " tu toi vous ils elles eux usted tú ellos ellas vosotros"
).split()
NEGATIONS = "not never no without nicht kein keine nie pas jamais sans nunca jamás sin".split()
REPORTS = (
    "said says called calls wrote writes quoted according reported claimed sagte sagt schrieb laut"
    " dit écrit selon dijo dice escribió según"
).split()

#: The bytes that end a clause.
CLAUSE_END = np.zeros(256, bool)
CLAUSE_END[[ord(c) for c in ".!?;:\n"]] = True

#: Lengths in bytes at which stems are looked up.
STEM_BYTES = range(4, 9)
#: What a threat weighs before the grammar's factors, as insults have weights of their own.
THREAT_WEIGHT = 2.0


class Grammar(NamedTuple):
    """Weights of insults and of insulting stems by hash, and the coefficients that make a score of
    a document's matches."""

    insults: dict[int, float]
    stems: dict[int, dict[int, float]]  # by length in bytes
    coefficients: tuple[float, ...]


class Transducers:
    """The composed grammar (see `transducers`), run over the words of one clause."""

    def __init__(self, grammar: Grammar):
        given = {"threat": THREATS, "negation": NEGATIONS, "report": REPORTS, "intent": INTENTS, "target": TARGETS}
        self.symbols = {text_hash(word): symbol for symbol, listed in reversed(given.items()) for word in listed}
        self.threats = frozenset(text_hash(word) for word in THREATS)
        self.machine = transducers.grammar()
        self.grammar = grammar

    def clause(self, marked: list[tuple[int, float]]) -> float:
        """The weight of a clause whose words are (hash, weight as an insult or 0)."""
        symbols = ["insult" if weight else self.symbols.get(word, "other") for word, weight in marked]
        weights = [weight or (THREAT_WEIGHT if symbol == "threat" else 0.0) for symbol, (_, weight) in zip(symbols, marked)]
        return self.machine.best(symbols, weights) or 0.0


def _matches(found, hashes: np.ndarray, insults: tuple, stems: dict) -> np.ndarray:
    """The weight of every word of a slice as an insult: of the word itself, or else of its longest known stem."""
    weights = np.zeros(len(hashes))
    lengths = found.ends - found.starts
    for size in STEM_BYTES:
        if size in stems:
            long = np.flatnonzero(lengths > size)
            heads = span_hashes(found, found.starts[long], found.starts[long] + size)
            weights[long] = np.maximum(weights[long], _look_up(heads, *stems[size]))
    return np.maximum(weights, _look_up(hashes, *insults))


def _table(weights: dict[int, float]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.array(sorted(weights), U64)
    return keys, np.array([weights[k] for k in sorted(weights)])


def _look_up(hashes: np.ndarray, keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(hashes))
    at = np.searchsorted(keys, hashes)
    at[at == len(keys)] = 0
    return np.where(keys[at] == hashes, values[at], 0.0)


MATCH_COLUMNS = ("top", "total", "clauses", "share")


def matched(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document what the grammar finds in its whole text: `top` (the heaviest clause), `total` (log of
    1 plus all clauses' weights), `clauses` (log of 1 plus how many match) and `share` (matches per 100
    words, at most 5). One pass without a shuffle; null and empty texts match nothing."""
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, " + ", ".join(f"{c} double" for c in MATCH_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducers(grammar)
        insults = _table(grammar.insults)
        stems = {size: _table(weights) for size, weights in grammar.stems.items() if weights}
        threats = np.array(sorted(machine.threats), U64)
        for batch in batches:
            out = np.zeros((batch.num_rows, len(MATCH_COLUMNS)))
            for lo, hi, data, offsets in slices(batch.column(1)):
                found = words(data, offsets, NOT_ALNUM)
                weights = _matches(found, found.hashes, insults, stems)
                threat = np.isin(found.hashes, threats)
                hits = np.flatnonzero((weights > 0) | threat)
                if not len(hits):
                    continue
                ends = np.cumsum(CLAUSE_END[data])[found.starts]
                doc = np.searchsorted(found.bounds, np.arange(len(ends)), "right") - 1
                new = np.ones(len(ends) + 1, bool)
                new[1:-1] = (ends[1:] != ends[:-1]) | (doc[1:] != doc[:-1])
                begins = np.flatnonzero(new)
                clauses = np.unique(np.searchsorted(begins, hits, "right") - 1)
                for i in np.unique(doc[hits]).tolist():
                    scores, count = [], 0
                    for c in clauses[(doc[begins[clauses]] == i)].tolist():
                        span = slice(begins[c], begins[c + 1])
                        score = machine.clause(list(zip(found.hashes[span].tolist(), weights[span].tolist())))
                        if score > 0:
                            scores.append(score)
                            count += int((weights[span] > 0).sum())
                    if scores:
                        n = found.bounds[i + 1] - found.bounds[i]
                        out[lo + i] = max(scores), math.log1p(sum(scores)), math.log1p(len(scores)), min(5.0, 100.0 * count / n)
            arrays = [pa.array(out[:, k]) for k in range(len(MATCH_COLUMNS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, *MATCH_COLUMNS])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def _contexts(sample: DataFrame) -> DataFrame:
    """(doc, word, before, toxic): the words of labelled texts and what stands before them, once per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        lower = {c: c + 32 for c in range(65, 91)}
        kinds = [("doc", pa.int64()), ("word", pa.string()), ("before", pa.string()), ("toxic", pa.int32())]
        for batch in batches:
            for i in range(batch.num_rows):
                doc, text, toxic = (batch.column(c)[i].as_py() for c in range(3))
                parts = [w for w in between.split((text or "").translate(lower)) if w]
                pairs = set(zip(parts, ["", *parts]))
                columns = [[doc] * len(pairs), [p[0] for p in pairs], [p[1] for p in pairs], [toxic] * len(pairs)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds)], schema=pa.schema(kinds))

    return sample.mapInArrow(run, "doc long, word string, before string, toxic int")


def _log_odds(share: Column, toxic: Column, clean: Column) -> Column:
    """How much likelier among toxic than among other contexts, with half a context added to both."""
    return F.log((toxic + 0.5) / share) - F.log((clean + 0.5) / (1 - share))


def learn(
    docs: DataFrame,
    labels: DataFrame,
    max_labelled: int = 8000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> Grammar:
    """Fits the grammar on at most about `max_labelled` labelled rows, drawn by a hash of the id.

    A word's weight comes from how many different words it follows in toxic and in other texts:
    a word that insults follows many, while words of a text that was copied often follow the same
    one in each copy. Stems sum up the words they begin, so unseen inflections match too.
    Words and stems count that occur with at least 6 contexts, first seen in at least 4 toxic texts, and ten
    times likelier there than elsewhere.
    The coefficients of the score are then a logistic fit on what the grammar matches in the same rows.

    Labels other than 0 and 1 are ignored; an id with both counts as toxic. Without any usable label, the seeds weigh 3.
    Other columns don't matter, whatever their names. Texts of any length are read whole; null and empty ones hold no
    words. Of rows of `docs` that share an id one is taken.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    labels = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic"))
    id_col, text_col, label_col = "doc_id", "text", "toxic"
    clean = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    clean = clean.groupBy(id_col).agg(F.max(label_col).cast("int").alias(label_col))
    n = clean.count()
    share = min(1.0, max_labelled / max(n, 1))
    drawn = clean.filter(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(share * 1_000_000))
    # About max_labelled rows of an id and a flag: a fixed bound, so the texts need no shuffle. One text an id.
    sample = docs.join(F.broadcast(drawn), id_col).groupBy(id_col, label_col).agg(F.min(F.struct(F.xxhash64(text_col), text_col)).alias("one"))
    sample = sample.select(id_col, f"one.{text_col}", label_col)

    key = F.xxhash64(id_col)
    contexts = _contexts(sample.select(key.alias("doc"), text_col, label_col)).groupBy("word", "before").agg(
        F.max("toxic").alias("toxic"), F.min("toxic").alias("least"), F.min("doc").alias("doc")
    )
    tables = Tables(docs.sparkSession, "toxicity")
    contexts = tables.settle(contexts)
    where = F.when(F.col("toxic") == 1, F.col("doc"))
    sums = [F.sum("toxic").alias("toxic"), F.sum(1 - F.col("least")).alias("clean"), F.count_distinct(where).alias("docs")]
    counted = contexts.groupBy("word").agg(*sums)
    counted = tables.settle(counted)
    totals = counted.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    toxic, other = float(totals["toxic"] or 0), float(totals["clean"] or 0)
    insults = {text_hash(w): 3.0 for w in INSULTS}
    stems: dict[int, dict[int, float]] = {}
    if toxic and other:
        weight = _log_odds(F.lit(toxic / (toxic + other)), F.col("toxic"), F.col("clean"))
        heads = F.array(*(F.when(F.char_length("word") > k, F.substring("word", 1, k)) for k in (4, 5, 6)))
        stemmed = contexts.select(F.explode(heads).alias("stem"), "word", "toxic", "least", "doc").filter("stem is not null")
        stemmed = stemmed.groupBy("stem").agg(*sums, F.approx_count_distinct("word").alias("words"))
        heavy = (F.col("toxic") >= 6) & (F.col("docs") >= 4) & (F.col("weight") >= math.log(10))
        for row in counted.withColumn("weight", weight).filter(heavy).collect():
            insults[text_hash(row["word"])] = row["weight"]
        found = stemmed.withColumn("weight", weight).filter(heavy & (F.col("words") >= 3))
        for row in found.collect():
            size = len(row["stem"].encode())
            if size in STEM_BYTES:
                stems.setdefault(size, {})[text_hash(row["stem"])] = row["weight"]
    tables.drop(counted, contexts)

    grammar = Grammar(insults, stems, ())
    hits = matched(sample, grammar, id_col, text_col).join(F.broadcast(drawn), id_col)
    rows = hits.select(label_col, *MATCH_COLUMNS).toPandas()  # about max_labelled rows of five numbers
    return grammar._replace(coefficients=_logistic(rows[list(MATCH_COLUMNS)].to_numpy(float), rows[label_col].to_numpy(float)))


#: The score of a document without any match, if no labels say otherwise, and what matches add.
UNLEARNED = (-4.0, 0.5, 1.0, 0.5, 0.5)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton's method for a logistic fit; coefficients below 0 are set to 0, as more matches never lower a score."""
    if len(y) < 20 or y.min() == y.max():
        return UNLEARNED
    x = np.column_stack([np.ones(len(x)), x])
    free = np.ones(x.shape[1], bool)
    beta = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(x.shape[1]):
        beta[:] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x[:, free] @ beta[free], -30, 30)))
            gradient = x[:, free].T @ (y - p) - penalty[free] * beta[free]
            hessian = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + np.diag(penalty[free])
            step = np.linalg.solve(hessian, gradient)
            beta[free] += step
            if np.abs(step).max() < 1e-8:
                break
        wrong = free & (beta < 0)
        wrong[0] = False
        if not wrong.any():
            break
        free &= ~wrong
    beta[~free] = 0
    return tuple(float(b) for b in beta)


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, what the grammar matched, and `score` between 0 and 1, higher for what is likelier toxic.

    Only the text counts. Null and empty texts match nothing and get the score of a text without
    matches. One row per row of `docs`, in a single pass; other columns don't matter.
    """
    start, *factors = grammar.coefficients or UNLEARNED
    total = F.lit(start)
    for factor, column in zip(factors, MATCH_COLUMNS):
        total = total + F.lit(factor) * F.col(column)
    return matched(docs, grammar, id_col, text_col).withColumn("score", 1 / (1 + F.exp(-total)))

