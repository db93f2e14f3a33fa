"""The pipeline's stages and the whole of it on a small corpus, against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

BLANKS = r"[\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def split(text):
    return [w for w in re.split(BLANKS, text or "") if w]


def made_up(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 5))) for _ in range(n))


def frame(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    full = [(i, text, "en", source, None if text is None else len(text)) for i, text, source in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.selectExpr("*", "1 as score", "2 as n_lines", "3 as gone", "4 as row", "5 as component_id", "6 as copies", "7 as _d", "8 as toxic")


def corpus(seed=4):
    rng = random.Random(seed)
    footer = "read all our pages again tomorrow morning"
    rows, originals = [], []
    for i in range(40):
        lines = [made_up(rng, rng.randint(6, 14)) for _ in range(rng.randint(4, 9))]
        originals.append((i, lines, f"s{i % 4}"))
        rows.append((i, "\n".join(lines + [footer] * (i % 3 == 0)), f"s{i % 4}"))
    for k in range(10):  # exact copies and near ones: one word in some lines
        _, lines, source = originals[3 * k]
        changed = [" ".join([*split(line)[:-1], "zz"]) if k % 2 and at == 1 else line for at, line in enumerate(lines)]
        rows.append((100 + k, "\n".join([*changed, footer]), source))
    rows += [(200, None, "s0"), (201, "", "s1"), (None, "no id at all\nand two lines", None), (202, footer, "s2"), (7, rows[7][1], rows[7][2])]
    rows += [(203, made_up(rng, 3000), "s3")]
    return rows


# -- line dedup -------------------------------------------------------------------------------------------


def near(a, b):
    if min(len(a), len(b)) < 5:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:j] + b[j + 1 :] == a for j in range(len(b)))


def plain_lines(rows, share=0.5):
    """(doc_id, text) of what the line stage keeps."""
    order = lambda i: (i is None, i or 0)
    first, docs = {}, {(order(i), text): i for i, text, _ in rows}
    at = sorted((key, text, k, tuple(split(line))) for key, text in docs if text for k, line in enumerate(text.split("\n")) if split(line))
    for key, text, k, words in at:
        first.setdefault(words, (key, text, k))
    origin, by_first = {}, sorted(first, key=first.get)
    for n, words in enumerate(by_first):
        closest = next((other for other in by_first[:n] if near(other, words)), None)
        origin[words] = (first[closest][:2], True) if closest else (first[words][:2], False)
    repeats = defaultdict(lambda: defaultdict(list))
    for key, text, k, words in at:
        if (key, text, k) != first[words] or origin[words][1]:
            repeats[key, text][origin[words][0]].append((k, len(words)))
    out = []
    for (key, text), doc_id in docs.items():
        parts = {source: sum(n for _, n in lines) for source, lines in repeats[key, text].items()}
        gone = {k for lines in repeats[key, text].values() for k, _ in lines}
        if parts:
            main = max(parts, key=lambda s: (parts[s], s))
            if parts[main] >= share * (len(split(text)) - sum(parts.values()) + parts[main]):
                gone -= {k for k, _ in repeats[key, text][main]}
        kept = [line for k, line in enumerate((text or "").split("\n")) if k not in gone]
        clean = text if not gone else "\n".join(kept) if any(split(line) for line in kept) else ""
        if not gone or clean:
            out.append((doc_id, clean))
    return sorted(out, key=str)


def test_line_stage(spark):
    rows = corpus()
    got = pipeline.drop_repeated_lines(spark, frame(spark, rows).repartition(3), "")
    assert got.columns == pipeline.COLUMNS
    left = got.collect()
    assert sorted({(r["doc_id"], r["text"]) for r in left}, key=str) == plain_lines(rows)
    assert sum(r["doc_id"] == 7 for r in left) == 2  # repeated rows keep the same lines
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in left)
    whole = {i: text for i, text, _ in rows}
    texts = {r["doc_id"]: r["text"] for r in left}
    assert 202 in texts or whole[202] in whole[0]
    assert all(len(split(texts[100 + k])) >= 0.8 * len(split(texts[3 * k])) for k in range(10))


# -- near copies ------------------------------------------------------------------------------------------


def shingles(text):
    w = [x.lower() for x in split(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_leaders(rows):
    sets = {i: shingles(text) for i, text in rows if i is not None}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return sorted(i for i in ids if root(i) == i)


def test_near_copies_after_the_line_stage(spark):
    rows = corpus()
    lines = pipeline.drop_repeated_lines(spark, frame(spark, rows), "").cache()
    got = pipeline.drop_near_copies(spark, lines.withColumn("component_id", F.lit(0)), "")
    assert got.columns == pipeline.COLUMNS
    texts = [(r["doc_id"], r["text"]) for r in lines.collect()]
    left = got.collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == plain_leaders(texts)
    assert sum(r["doc_id"] is None for r in left) == 1
    caught = [k for k in range(10) if 100 + k not in {r["doc_id"] for r in left}]
    assert len(caught) >= 9
    assert {i for i in range(40)} <= {r["doc_id"] for r in left}


# -- toxicity ---------------------------------------------------------------------------------------------


def test_toxic_documents_go(spark, tmp_path):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(300):
        text = ". ".join(made_up(rng, 9) for _ in range(4))
        if i % 6 == 0:
            text += ". you are a stupid " + rng.choice(["idiot", "moron", "idiot"]) + " and you are a pathetic idiot"
        rows.append((i, text, "s"))
        labels.append((i, int(i % 6 == 0)))
    rows += [(900, None, "s"), (901, "", "s"), (None, "you are a stupid idiot and you are a pathetic moron", None), (1, rows[1][1], "s")]
    spark.createDataFrame(labels, "doc_id long, toxic int").withColumn("quality", F.lit(1)).write.parquet(str(tmp_path / "labels.parquet"))
    got = pipeline.drop_toxic(spark, frame(spark, rows), str(tmp_path))
    assert got.columns == pipeline.COLUMNS
    ids = Counter(r["doc_id"] for r in got.collect())
    clean = [i for i in range(300) if i % 6]
    assert sum(ids[i] > 0 for i in clean) >= 0.99 * len(clean) and sum(ids[i] > 0 for i in range(0, 300, 6)) <= 1
    assert ids[900] == ids[901] == 1 and ids[None] == 0 and ids[1] == 2


# -- mixing and packing -----------------------------------------------------------------------------------


def test_mixed_sources_come_near_their_targets(spark):
    rng = random.Random(3)
    rows = [(i, made_up(rng, rng.randint(5, 60)), ["a", "a", "a", "b", None][i % 5]) for i in range(400)]
    rows += [(1, rows[1][1], "a"), (500, None, "a"), (501, "", "b")]
    got = pipeline.mix_sources(spark, frame(spark, rows).repartition(3), "")
    assert got.columns == pipeline.COLUMNS
    words, size = Counter(), Counter()
    for i, text, source in rows:
        size[source] += len(split(text))
    for r in got.collect():
        assert (r["doc_id"], r["text"], r["source"]) in rows
        words[r["source"]] += len(split(r["text"]))
    total, weights = sum(size.values()), {"a": 1, "b": 2, None: 3}
    target, left, free = {}, total, set(weights)
    while True:
        share = {s: left * weights[s] / sum(weights[f] for f in free) for s in free}
        over = [s for s in free if share[s] > 3 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * size[s]
            left -= target[s]
            free.discard(s)
    for source, want in target.items():
        assert abs(words[source] - want) <= 60


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    rows = corpus()
    frame(spark, rows).select(*pipeline.COLUMNS).repartition(2).write.parquet(str(path / "documents.parquet"))
    labels = spark.createDataFrame([(i, 0, 1) for i in range(0, 40, 2)], "doc_id long, toxic int, quality int")
    labels.write.parquet(str(path / "labels.parquet"))
    return str(path), rows


def test_the_whole_pipeline(spark, folder, vocabulary):
    """Its rows are those of the last stage over what plain Python says the first three keep."""
    from tokenizers import Tokenizer

    path, rows = folder
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_jaccard_join", "source_mixing", "packing"]
    pieces = pipeline.run(spark, path).collect()
    kept = dict(plain_lines(rows))
    leaders = set(plain_leaders(plain_lines(rows)))
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    spans, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p["doc_id"] is None or p["doc_id"] in leaders
        assert p["doc_tokens"] == len(library.encode(kept[p["doc_id"]] or "", add_special_tokens=False).ids) + 1
        spans[p["doc_id"]].append((p["start"], p["length"], p["doc_tokens"]))
        sequences[p["sequence_id"]].append((p["offset"], p["length"], p["sequence_tokens"]))
    for doc_id, parts in spans.items():
        taken = sum(length for _, length, _ in parts) / parts[0][2]
        assert taken in (1, 2, 3), doc_id
    for members in sequences.values():
        ends = np.cumsum([length for _, length, _ in sorted(members)])
        assert [o for o, _, _ in sorted(members)] == [0, *ends[:-1]] and ends[-1] == members[0][2] <= 2048
    again = pipeline.run(spark, path).collect()
    taken = lambda rows: Counter((p["doc_id"], p["doc_tokens"]) for p in rows if p["start"] == 0)
    assert taken(again) == taken(pieces)


def test_an_empty_corpus(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert pipeline.run(spark, str(tmp_path)).collect() == []
