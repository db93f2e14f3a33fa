"""Quality classifier by co-training: a view of the text and a view of the page teach each other.

Two logistic classifiers see different things: one the words of a text, by hash, and what they are like, the
other how the page is laid out and where it comes from. Starting from labelled rows, each round lets either view
name the documents it is surest of, and the other view learns from them. In the end both views
are calibrated on labelled rows and combined.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetime.llm.fertility import repeated_words
from placetime.llm.tables import Tables
from placetime.llm.words import BLANK, U64, slices, words

LETTER = np.zeros(256, bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
POINT = np.zeros(256, bool)
POINT[[ord(c) for c in ".,;:!?'\"()-"]] = True
SIGN = np.zeros(256, bool)
SIGN[[ord(c) for c in "#*$%&|<>=+~^_@\\/[]{}`"]] = True

TEXT_VIEW = (
    "word_bytes", "upper", "digits", "signs", "points", "different", "again", "most_common", "mixed", "short_words", "log_words"
)
#: Words of a text fall into so many bins by hash; sources and languages of a page as well. Hessians grow with
#: their squares, so the numbers are bounds of what comes to the driver.
WORD_BINS = 64
SOURCE_BINS, LANG_BINS = 64, 16
PAGE_LAYOUT = ("log_chars", "log_lines", "line_chars", "short_lines", "blank_lines", "same_lines", "log_words_per_line")


def text_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row per text: what its words are like, and which words they are (root of the share of each bin of hashes)."""
    found = words(data, offsets, BLANK)
    totals = [np.concatenate([[0], np.cumsum(kind[data])]) for kind in (LETTER, UPPER, DIGIT, SIGN, POINT)]
    lengths = found.ends - found.starts
    signs = np.concatenate([[0], np.cumsum(SIGN[data] | POINT[data])])
    dirty = (signs[found.ends] - signs[found.starts]) > 0
    out = np.zeros((len(offsets) - 1, len(TEXT_VIEW) + WORD_BINS))
    bins = (found.hashes % U64(WORD_BINS)).astype(np.int64)
    for i in range(len(out)):
        a, b = found.bounds[i], found.bounds[i + 1]
        n = int(b - a)
        if not n:
            continue
        letters, upper, digits, sign, point = (t[offsets[i + 1]] - t[offsets[i]] for t in totals)
        size = max(1, int(lengths[a:b].sum()))
        _, times = np.unique(found.hashes[a:b], return_counts=True)
        out[i, len(TEXT_VIEW) :] = np.sqrt(np.bincount(bins[a:b], minlength=WORD_BINS) / n)
        out[i, : len(TEXT_VIEW)] = (
            size / n / 10, upper / max(1, letters), digits / size, sign / size, point / n,
            len(times) / n ** 0.9, repeated_words(found.hashes[a:b]) / n, times.max() / n,
            dirty[a:b].mean(), (lengths[a:b] <= 2).mean(), np.log1p(n) / 10,
        )
    return out


def page_layout(text: str) -> tuple[float, ...]:
    """How a page is laid out, without regard to its words."""
    lines = text.split("\n")
    full = [line for line in lines if line.strip()]
    n = max(1, len(full))
    sizes = [len(line) for line in full]
    return (
        np.log1p(len(text)) / 10, np.log1p(len(lines)) / 5, np.log1p(np.mean(sizes) if sizes else 0) / 5,
        sum(s < 30 for s in sizes) / n, 1 - len(full) / len(lines), 1 - len(set(full)) / n,
        np.log1p(np.mean([line.count(" ") + 1 for line in full]) if full else 0) / 5,
    )


def _bin(column: Column, bins: int) -> Column:
    return F.when(column.isNull(), 0).otherwise(F.pmod(F.xxhash64(column), F.lit(bins - 1)) + 1).cast("int")


def views(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(id, text_view, page_view): the two views of every whole text as arrays; one pass without a shuffle.

    The page view has the layout and, hashed into bins, source and language. Nulls count as empty texts and as bins of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, page = [], np.zeros((batch.num_rows, len(PAGE_LAYOUT) + SOURCE_BINS + LANG_BINS))
            for lo, hi, data, offsets in slices(batch.column(1)):
                text.append(text_view(data, offsets))
                for i in range(hi - lo):
                    page[lo + i, : len(PAGE_LAYOUT)] = page_layout(data[offsets[i] : offsets[i + 1]].tobytes().decode())
            rows = np.arange(batch.num_rows)
            page[rows, len(PAGE_LAYOUT) + batch.column(2).to_numpy()] = 1
            page[rows, len(PAGE_LAYOUT) + SOURCE_BINS + batch.column(3).to_numpy()] = 1
            both = [np.vstack(text) if text else np.zeros((0, len(TEXT_VIEW) + WORD_BINS)), page]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([x.tobytes() for x in v.astype("<f4")], pa.binary()) for v in both)],
                names=[id_col, "text_view", "page_view"],
            )

    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, text_view binary, page_view binary"
    given = docs.select(F.col(id_col), F.col(text_col), _bin(F.col(source_col), SOURCE_BINS), _bin(F.col(lang_col), LANG_BINS))
    return given.mapInArrow(run, schema)


class View(NamedTuple):
    """A logistic classifier of standardised features."""

    middle: np.ndarray
    spread: np.ndarray
    beta: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.beta[0] + np.clip((x - self.middle) / self.spread, -8, 8) @ self.beta[1:], -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _design(view: View, x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.clip((x - view.middle) / view.spread, -8, 8)])


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(n, -1).astype(np.float64) if n else np.zeros((0, 1))


def _sums(df: DataFrame, function, names: list[str]) -> dict[str, np.ndarray]:
    """Adds up arrays over all rows: `function` gives a dict of arrays for a batch, each task its sums, and one
    row per name and group of tasks comes to the driver. Sizes follow from the number of features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            if batch.num_rows:
                for name, value in function(batch).items():
                    total[name] = total.get(name, 0) + value
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.string()), pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.float64()))],
            names=["name", "value"],
        )

    parts = df.mapInArrow(run, "name string, value array<double>")
    cells = parts.select("name", F.posexplode("value").alias("at", "x")).groupBy("name", "at").agg(F.sum("x").alias("x"))
    out: dict[str, dict[int, float]] = {name: {} for name in names}
    for row in cells.collect():  # features squared
        out[row["name"]][row["at"]] = row["x"]
    return {name: np.array([cells[i] for i in sorted(cells)]) for name, cells in out.items()}


class Teacher(NamedTuple):
    """What the views know: their classifiers, and the margins beyond which each is sure."""

    text: View
    page: View
    text_sure: tuple[float, float]  # surely bad below, surely good above
    page_sure: tuple[float, float]


def _targets(batch: pa.RecordBatch, teacher: Teacher | None, pupil: str) -> tuple[np.ndarray, np.ndarray]:
    """(weight, label) of a batch for one view: given labels count fully, those that the other view is sure of by a part."""
    given = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float)
    known = ~np.isnan(given)
    weight, label = known.astype(float), np.where(known, given, 0.0)
    if teacher is not None:
        other = "page" if pupil == "text" else "text"
        margin = getattr(teacher, other).margin(_matrix(batch.column(batch.schema.get_field_index(f"{other}_view"))))
        low, high = getattr(teacher, f"{other}_sure")
        for sure, value in ((margin < low, 0.0), (margin > high, 1.0)):
            weight = np.where(~known & sure, PSEUDO_WEIGHT, weight)
            label = np.where(~known & sure, value, label)
    return weight, label


PSEUDO_WEIGHT = 0.25
#: A view names the documents that it is surest of: about these shares of all, on either side, more each round.
SURE_SHARE = 0.02
RIDGE = 3.0
BIN_RIDGE = 100.0
NEWTON_ROUNDS = 4


def _penalty(name: str, k: int) -> np.ndarray:
    """Ridge per coefficient: none for the constant, more for the many bins than for the few measures."""
    penalty = np.full(k, RIDGE * BIN_RIDGE)
    penalty[: 1 + len(TEXT_VIEW if name == "text" else PAGE_LAYOUT)] = RIDGE
    penalty[0] = 1e-6
    return penalty


def _fit(rows: DataFrame, views_now: dict[str, View], teacher: Teacher | None) -> dict[str, View]:
    """Newton iterations for both views at once; gradients and Hessians are summed over all rows by Spark."""
    now, moving = dict(views_now), list(views_now)
    for _ in range(NEWTON_ROUNDS):

        def step(batch: pa.RecordBatch, given: tuple = tuple((name, now[name]) for name in moving)) -> dict[str, np.ndarray]:
            out = {}
            for name, view in given:
                weight, label = _targets(batch, teacher, name)
                used = weight > 0
                x = _design(view, _matrix(batch.column(batch.schema.get_field_index(f"{name}_view")))[used])
                p = sigmoid(np.clip(x @ view.beta, -30, 30))
                w, y = weight[used], label[used]
                out[f"{name} gradient"] = x.T @ (w * (y - p))
                out[f"{name} hessian"] = (x * (w * p * (1 - p))[:, None]).T @ x
            return out

        sums = _sums(rows, step, [f"{name} {part}" for name in moving for part in ("gradient", "hessian")])
        for name in list(moving):
            view = now[name]
            k = len(view.beta)
            if not len(sums[f"{name} gradient"]):
                moving.remove(name)
                continue
            penalty = _penalty(name, k)
            gradient = sums[f"{name} gradient"] - penalty * view.beta
            change = np.linalg.solve(sums[f"{name} hessian"].reshape(k, k) + np.diag(penalty + 1e-9), gradient)
            change *= min(1.0, 5.0 / max(1e-12, np.abs(change).max()))
            now[name] = view._replace(beta=view.beta + change)
            if np.abs(change).max() < 1e-3:
                moving.remove(name)
        if not moving:
            break
    return now


BINS = np.linspace(-30, 30, 1201)


def _sure(rows: DataFrame, views_now: dict[str, View], share: float) -> dict[str, tuple[float, float]]:
    """Per view the margins that cut off the `share` of all documents it is surest of on either side."""

    def count(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {}
        for name, view in views_now.items():
            margin = view.margin(_matrix(batch.column(batch.schema.get_field_index(f"{name}_view"))))
            out[name] = np.histogram(margin, BINS)[0].astype(float)
        return out

    found = _sums(rows, count, list(views_now))
    sure = {}
    for name, counts in found.items():
        upto = np.cumsum(counts) / max(1.0, counts.sum())
        low = BINS[np.searchsorted(upto, share)]
        high = BINS[np.searchsorted(upto, 1 - share * 4)]
        sure[name] = (min(float(low), -0.5), max(float(high), 0.5))  # never against the view's own verdict
    return sure


class Quality(NamedTuple):
    text: View
    page: View
    scales: dict[str, tuple[float, float]]  # calibrated margin: a + b * margin
    combined: tuple[float, float, float]


def train(rows: DataFrame, rounds: int = 3) -> Quality:
    """Co-trains both views on rows (id, text_view, page_view, label), label null where there is none.

    Each round both views learn from the given labels and from what the other view was sure of in the
    round before, over all documents; the share a view may name grows by `SURE_SHARE` a round.
    Calibration and combination use the given labels alone. Only sums whose size follows from the
    number of features come to the driver. Without labels of both kinds every document gets 0.5.
    """
    sizes = {"text": len(TEXT_VIEW) + WORD_BINS, "page": len(PAGE_LAYOUT) + SOURCE_BINS + LANG_BINS}

    def moments(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        out = {"n": np.array([float(batch.num_rows)])}
        label = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float)
        out["labels"] = np.array([(label == 0).sum(), (label == 1).sum()], float)
        for name in sizes:
            x = _matrix(batch.column(batch.schema.get_field_index(f"{name}_view")))
            out |= {f"{name}1": x.sum(axis=0), f"{name}2": (x * x).sum(axis=0)}
        return out

    sums = _sums(rows, moments, ["n", "labels", "text1", "text2", "page1", "page2"])
    plain = {name: View(np.zeros(k), np.ones(k), np.zeros(k + 1)) for name, k in sizes.items()}
    flat = Quality(plain["text"], plain["page"], {"text": (0.0, 1.0), "page": (0.0, 1.0)}, (0.0, 1.0, 1.0))
    if not len(sums["n"]) or sums["labels"].min() == 0:
        return flat
    now = {}
    for name, k in sizes.items():
        middle = sums[f"{name}1"] / sums["n"]
        spread = np.sqrt(np.maximum(sums[f"{name}2"] / sums["n"] - middle**2, 1e-8))
        now[name] = View(middle, spread, np.zeros(k + 1))
    teacher = None
    for turn in range(rounds + 1):
        now = _fit(rows, now, teacher)
        if turn < rounds:
            sure = _sure(rows, now, SURE_SHARE * (turn + 1))
            teacher = Teacher(now["text"], now["page"], sure["text"], sure["page"])

    labelled = rows.filter("label is not null")
    scales = {}
    for name, view in now.items():
        scales[name] = tuple(_calibrated(labelled, lambda batch, name=name, view=view: [view.margin(_matrix(batch.column(batch.schema.get_field_index(f"{name}_view"))))], 1))

    def both(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [scales[n][0] + scales[n][1] * now[n].margin(_matrix(batch.column(batch.schema.get_field_index(f"{n}_view")))) for n in ("text", "page")]

    return Quality(now["text"], now["page"], scales, tuple(_calibrated(labelled, both, 2)))


def _calibrated(labelled: DataFrame, margins, k: int) -> np.ndarray:
    """Coefficients of a logistic fit of the labels on the margins."""
    beta = np.concatenate([[0.0], np.full(k, 1.0 / k)])
    for _ in range(6):

        def step(batch: pa.RecordBatch, beta: np.ndarray = beta) -> dict[str, np.ndarray]:
            y = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(float)
            x = np.column_stack([np.ones(len(y)), *margins(batch)])
            p = sigmoid(np.clip(x @ beta, -30, 30))
            return {"gradient": x.T @ (y - p), "hessian": (x * (p * (1 - p))[:, None]).T @ x}

        sums = _sums(labelled, step, ["gradient", "hessian"])
        change = np.linalg.solve(sums["hessian"].reshape(k + 1, k + 1) + 1e-3 * np.eye(k + 1), sums["gradient"])
        change *= min(1.0, 2.0 / max(1e-12, np.abs(change).max()))
        beta = beta + change
        if np.abs(change).max() < 1e-4:
            break
    beta[1:] = np.maximum(beta[1:], 0.0)  # a view never speaks against itself
    return beta


def score(viewed: DataFrame, quality: Quality, id_col: str = "doc_id") -> DataFrame:
    """(id, text_score, page_score, score): calibrated scores of either view and of both, for all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            single = []
            for name in ("text", "page"):
                a, b = quality.scales[name]
                single.append(a + b * getattr(quality, name).margin(_matrix(batch.column(batch.schema.get_field_index(f"{name}_view")))) if batch.num_rows else np.zeros(0))
            start, one, other = quality.combined
            both = start + one * single[0] + other * single[1]
            columns = [pa.array(sigmoid(np.clip(m, -30, 30))) for m in (*single, both)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[id_col, "text_score", "page_score", "score"])

    schema = f"`{id_col}` {dict(viewed.dtypes)[id_col]}, text_score double, page_score double, score double"
    return viewed.select(id_col, "text_view", "page_view").mapInArrow(run, schema)


def classify(
    docs: DataFrame, labels: DataFrame, rounds: int = 3, id_col: str = "doc_id", label_col: str = "quality",
    text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
) -> DataFrame:
    """Per row of `docs`: id, text_score, page_score and score, the chance that its quality is 1.

    Views are taken of every whole text and written, a few hundred bytes a document; training and scoring
    read them. Labels other than 0 and 1 are ignored, and an id with both counts as 0. Null and empty texts have
    views like any other, and texts of any length are read whole. Repeated rows give a row each, and each
    counts in training; a null id has no label. Other columns don't matter. An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "cotraining")
    viewed = tables.settle(views(docs, id_col, text_col, source_col, lang_col))
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("double").alias("label"))
    rows = tables.settle(viewed.join(known, F.col(id_col) == F.col("_id"), "left").drop("_id"))
    tables.drop(viewed)
    quality = train(rows, rounds)
    return score(rows, quality, id_col)
