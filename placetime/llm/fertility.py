"""Quality rules on tokeniser fertility, beside plain rules on counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placetime.llm.tokenizing import PieceBpe
from placetime.llm.words import BLANK, run_shingles, slices, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

#: Scripts told apart by their letters, where a document names no language (fixed values: Unicode blocks).
SCRIPTS = {
    "Latin": r"A-Za-zÀ-ɏ", "Greek": r"Ͱ-Ͽ", "Cyrillic": r"Ѐ-ԯ", "Hebrew": r"֐-׿",
    "Arabic": r"؀-ۿ", "Devanagari": r"ऀ-ॿ", "Thai": r"฀-๿", "Hangul": r"가-힯",
    "Kana": r"぀-ヿ", "Han": r"一-鿿",
}

MEASURES = ("chars_per_token", "byte_share", "token_entropy")
WINDOW = 5
ENTROPY_WINDOW = 64


def repeated_words(hashes: np.ndarray) -> int:
    """Words that stand in a window of `WINDOW` words found twice or more, the first one included."""
    windows = run_shingles(hashes, WINDOW)
    if len(windows) < 2:
        return 0
    _, back, times = np.unique(windows, return_inverse=True, return_counts=True)
    marks = np.zeros(len(hashes) + 1, np.int64)
    twice = np.flatnonzero(times[back] > 1)
    np.add.at(marks, twice, 1)
    np.add.at(marks, twice + WINDOW, -1)
    return int((np.cumsum(marks)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    """Lines holding a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    """Bits per token of the token distribution in windows of `ENTROPY_WINDOW` tokens, averaged over the
    whole text, as a share of the most there can be; so long and short texts compare."""
    size = min(ENTROPY_WINDOW, len(ids))
    if size < 2:
        return 1.0
    rows = ids[: len(ids) // size * size].reshape(-1, size)
    if len(ids) % size:
        rows = np.vstack([rows, ids[-size:]])
    rows = np.sort(rows, axis=1)
    new = np.ones(rows.shape, bool)
    new[:, 1:] = rows[:, 1:] != rows[:, :-1]
    begins = np.append(np.flatnonzero(new.ravel()), rows.size)
    times = np.diff(begins)
    return float(1 - (times * np.log2(times)).sum() / rows.size / np.log2(size))


def measures(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """Counts and fertility measures of every whole text, one pass without a shuffle.

    Returns id, `band_key` (the language code if it is one, else the script most letters belong
    to), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_tokens, chars_per_token,
    byte_share and token_entropy. A null text has no words; measures of texts without tokens are null.
    """
    counts = "n_words n_tokens word_chars n_symbols n_dup_lines n_repeat_words".split()
    schema = f"`{id_col}` {dict(docs.dtypes)[id_col]}, band_key string, " + ", ".join(f"{c} long" for c in counts)
    schema += ", " + ", ".join(f"{c} double" for c in MEASURES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceBpe(tokenizer)
        for batch in batches:
            out: list[tuple] = []
            for lo, hi, data, offsets in slices(batch.column(2)):
                found = words(data, offsets, BLANK, fold=False)
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                symbols = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
                chars = np.concatenate([[0], np.cumsum(lead[found.ends] - lead[found.starts])])
                for i in range(hi - lo):
                    a, b = found.bounds[i], found.bounds[i + 1]
                    text = data[offsets[i] : offsets[i + 1]].tobytes().decode()
                    ids = pieces.ids(text)
                    n, letters = len(ids), int(chars[b] - chars[a])
                    out.append(
                        (int(b - a), n, letters, int(symbols[offsets[i + 1]] - symbols[offsets[i]]), repeated_lines(text),
                         repeated_words(found.hashes[a:b]), letters / n if n else None,
                         float(pieces.is_byte[ids].mean()) if n else None, entropy(ids) if n else None)
                    )
            kinds = [pa.int64()] * 6 + [pa.float64()] * 3
            columns = list(zip(*out)) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                names=[id_col, "band_key", *counts, *MEASURES],
            )

    return docs.select(F.col(id_col), _band_key(F.col(lang_col), F.col(text_col)).alias("band_key"), F.col(text_col)).mapInArrow(
        run, schema
    )


def _band_key(lang: Column, text: Column) -> Column:
    """A code of two or three letters, or the name of a script: at most 18,263 keys whatever the table holds."""
    code = F.lower(F.trim(lang))
    letters = F.array(
        *(
            F.struct(F.length(F.regexp_replace(text, f"[^{letters}]+", "")).alias("n"), F.lit(name).alias("name"))
            for name, letters in SCRIPTS.items()
        )
    )
    script = F.array_max(letters)["name"]
    return F.when(code.rlike("^[a-z]{2,3}$"), code).otherwise(F.coalesce(script, F.lit("Latin")))


def bands(measured: DataFrame, reach: float = 2.0) -> DataFrame:
    """Per key, the middle of each measure and how far from it a long text may lie.

    All documents count. The middle is the median and the spread that of the half of the documents
    around it, so junk, as long as it is the smaller part, doesn't move the bands.
    """
    usable = measured.filter(F.col("n_tokens") > 0)
    quarters = usable.groupBy("band_key").agg(
        *(F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in MEASURES)
    )
    out = ["band_key"]
    for m in MEASURES:
        spread = F.col(m)[2] - F.col(m)[0]
        out += [F.col(m)[1].alias(f"{m}_mid"), (reach * spread).alias(f"{m}_reach")]
    return quarters.select(*out)


#: What a band is widened by at least, and by what over the root of the tokens: short texts vary more.
LEAST = {"chars_per_token": 0.2, "byte_share": 0.02, "token_entropy": 0.012}
SHORT = {"chars_per_token": 7.0, "byte_share": 0.4, "token_entropy": 0.45}


def judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """`measured` with base_failed, fertility_failed (the first measure outside its band, null if none) and kept.

    A text fails if it has fewer than 10 words or more than 20 % repeated words (the base), or if
    its characters per token or token entropy fall below the band of its key, its characters per
    token or byte share rise above it. The bands have one row per language code or script, so they
    are broadcast. Texts without tokens fail by the base.
    """
    with_bands = measured.join(F.broadcast(limits), "band_key", "left")

    def reach(m: str) -> Column:
        return F.col(f"{m}_reach") + LEAST[m] + SHORT[m] / F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)))

    def low(m: str) -> Column:
        return F.col(m) < F.col(f"{m}_mid") - reach(m)

    def high(m: str) -> Column:
        return F.col(m) > F.col(f"{m}_mid") + reach(m)

    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    outside = F.coalesce(
        F.when(low("chars_per_token") | high("chars_per_token"), "chars_per_token"),
        F.when(high("byte_share"), "byte_share"),
        F.when(low("token_entropy"), "token_entropy"),
    )
    return (
        with_bands.withColumn("base_failed", base)
        .withColumn("fertility_failed", outside)
        .withColumn("kept", ~F.col("base_failed") & F.col("fertility_failed").isNull())
        .select(*measured.columns, "base_failed", "fertility_failed", "kept")
    )
