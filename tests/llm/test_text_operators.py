"""Operators on texts against brute force, on small fixtures with nulls, empty and long texts, ties and copies."""

import random
import re

import numpy as np
import pytest

from placetime.llm import cotraining, fertility, licenses, line_dedup, mixing, token_counts, toxicity
from placetime.llm.ngram_join import jaccard_components
from placetime.llm.packing import _Bins, class_of, pack
from placetime.llm.tables import Tables
from placetime.llm.tokenizing import ByteBpe
from placetime.llm.words import BLANK, NOT_ALNUM, slices, words

BLANKS = "[\x20\x09-\x0D]+"


def split(text):
    return [w for w in re.split(BLANKS, text or "") if w]


def made_up(rng, n, letters="abcde"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 4))) for _ in range(n))


# --- words -----------------------------------------------------------------------------------------------


def test_words_match_a_plain_split():
    import pyarrow as pa

    texts = ["a B\tc", None, "", " \n ", "é è\xa0x ", "AbC abc ABC", "z"]
    for lo, hi, data, offsets in slices(pa.array(texts), most=3):
        found = words(data, offsets, BLANK)
        for i in range(lo, hi):
            a, b = found.bounds[i - lo], found.bounds[i - lo + 1]
            got = [data[s:e].tobytes().decode() for s, e in zip(found.starts[a:b], found.ends[a:b])]
            assert got == split(texts[i])
    (_, _, data, offsets), = slices(pa.array(["AbC abc ABC x"]))
    assert len(set(words(data, offsets, BLANK).hashes.tolist())) == 2
    (_, _, data, offsets), = slices(pa.array(["don't 9é!"]))
    assert len(words(data, offsets, NOT_ALNUM).starts) == 3


# --- 5 packing -------------------------------------------------------------------------------------------


def test_packing_round_trip(spark, documents, vocabulary):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (4, "x " * 3000), (None, "no id")]
    rows += [(10 + i, made_up(rng, rng.randint(1, 400))) for i in range(60)]
    rows += [(90, "日本語 <|endoftext|> don't\n\n  x\x1cy")]
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    want = sorted(((i is None, i or 0), [*library.encode(t or "", add_special_tokens=False).ids, 1]) for i, t in rows)
    pieces = pack(documents(rows).repartition(3), vocabulary("byte_bpe_50k.json"), capacity=64).collect()
    sequences = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        sequences.setdefault(p["sequence_id"], []).append(p)
    padding = 0
    for members in sequences.values():
        members.sort(key=lambda p: p["offset"])
        upto = 0
        for p in members:
            assert p["offset"] == upto and p["sequence_tokens"] == sum(m["length"] for m in members)
            upto += p["length"]
        assert upto <= 64
        padding += 0 if upto & (upto - 1) == 0 else 64 - upto
    assert padding == 0
    # Each document's pieces join to its ids.
    by_doc = {}
    for p in pieces:
        by_doc.setdefault((p["doc_id"] is None, p["doc_id"] or 0), []).append(p)
    got = []
    for key, parts in by_doc.items():
        copies = sum(p["start"] == 0 for p in parts)
        parts.sort(key=lambda p: p["start"])
        for c in range(copies):
            ids = np.concatenate([np.frombuffer(p["ids"], "<u4") for p in parts[c::copies]])
            got.append((key, ids.tolist()))
    assert sorted(got) == want


def test_added_tokens_as_in_a_plain_call(documents, vocabulary):
    from tokenizers import Tokenizer

    path, rng = vocabulary("byte_bpe_50k.json"), random.Random(6)
    library, encoder = Tokenizer.from_file(path), ByteBpe(path, added_tokens=True)
    assert encoder.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    alphabet = ["a", "word", " ", "  ", "\n", "<|endoftext|>", "<|endo", "ftext|>", "日", "'s", "\xa0"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        want = library.encode(text, add_special_tokens=False).ids
        assert encoder.ids(text).tolist() == want
        tree = token_counts.build(text, encoder, leaf_words=2)
        assert tree.total == len(want)
        cut = rng.randint(0, len(text))
        after, tree, _ = token_counts.edit(text, tree, [(cut, min(len(text), cut + 5), "|>")], encoder, leaf_words=2)
        assert tree.total == len(library.encode(after, add_special_tokens=False).ids)
    text = "a <|endoftext|> b"
    (piece,) = pack(documents([(1, text)]), path, capacity=5, added_tokens=True).collect()
    assert np.frombuffer(piece["ids"], "<u4").tolist() == [64, 220, 50256, 275, 1]


def test_packing_keeps_documents_whole_where_they_fit():
    """Sequences are full, bins of class 1/j hold j documents of it, and few documents are cut."""
    assert [class_of(n, 2048) for n in (2047, 1025, 1024, 683, 682, 158, 157)] == [1, 1, 2, 2, 3, 12, 0]
    for seed, lengths in ((1, (1, 2048)), (2, (700, 2048)), (3, (1, 60)), (4, (1, 9000)), (5, (1025, 1025)), (6, (600, 700))):
        rng, bins, pieces = random.Random(seed), _Bins(2048, 0), []
        sizes = [rng.randint(*lengths) for _ in range(3000)]
        for doc, n in enumerate(sizes):
            pieces += bins.add(doc, np.full(n, doc, "<u4"))
            assert len(bins.waiting) <= 64 and bins.small_tokens < 2048 and all(len(held) < j for j, held in bins.open.items())
        pieces += bins.rest()
        spans, sequences = {}, {}
        for doc, start, length, ids, tokens, sequence, offset, whole in pieces:
            assert tokens == sizes[doc] and ids == np.full(length, doc, "<u4").tobytes()
            spans.setdefault(doc, []).append((start, length))
            sequences.setdefault(sequence, []).append((offset, length, whole))
        for doc, n in enumerate(sizes):
            upto = 0
            for start, length in sorted(spans[doc]):
                assert start == upto
                upto += length
            assert upto == n
        partial = 0
        for members in sequences.values():
            whole = sum(length for _, length, _ in members)
            assert [m[0] for m in members] == [sum(m[1] for m in members[:k]) for k in range(len(members))]
            assert {m[2] for m in members} == {whole} and whole & (whole - 1) == 0
            partial += whole < 2048
        assert partial <= 11
        fitting = [doc for doc, n in enumerate(sizes) if n <= 2048]
        if seed in (1, 2, 3):
            assert sum(len(spans[doc]) > 1 for doc in fitting) <= {1: 0.3, 2: 0.6, 3: 0.03}[seed] * len(fitting)


def test_packing_of_nothing(documents, vocabulary):
    assert pack(documents([(1, "a")]).limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


# --- 7 n-gram join ---------------------------------------------------------------------------------------


def brute_components(rows, size, percent):
    def grams(text):
        w = split((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])

    sets = [(i, grams(t)) for i, t in rows]
    usable = [x for x in sets if x[0] is not None and x[1]]
    parent = list(range(len(usable)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(usable)):
        for b in range(a):
            one, two = usable[a][1], usable[b][1]
            if 100 * len(one & two) >= percent * len(one | two):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(usable):
        least[root(k)] = min(least.get(root(k), i), i)
    named = iter(least[root(k)] for k in range(len(usable)))
    return sorted((i is None, i or 0, len(s), (next(named) if i is not None and s else i) or 0) for i, s in sets)


@pytest.mark.parametrize("size, percent", [(3, 90), (5, 80), (2, 50)])
def test_ngram_join_against_brute_force(documents, size, percent):
    rng = random.Random(size)
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (None, "one two"), (6, "one"), (7, "one two three four five")]
    rows += [(7, "one two three four five"), (7, "quite another text for the same id here")]
    for g in range(8):
        base = split(made_up(rng, rng.randint(8, 120)))
        for c in range(rng.randint(1, 9)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = made_up(rng, 1)
            rows.append((100 + 10 * g + c, " ".join(text)))
    rows += [(300 + i, made_up(rng, 30, "ab")) for i in range(20)]
    rows += [(400, "long " + made_up(rng, 5000)), (401, "w " * 4000)]
    got = jaccard_components(documents(rows).repartition(3), size, percent).collect()
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"] or 0) for r in got)
    assert got == brute_components(rows, size, percent)


def test_fine_ranges_bound_the_overlap():
    from placetime.llm.ngram_join import fine_ranges, most_common

    rng = np.random.default_rng(5)
    for n, m, both in ((1, 1, 1), (1, 900, 1), (40, 700, 20), (500, 520, 480), (3000, 3000, 100), (5, 6, 0)):
        shared, one, other = (rng.integers(0, 2**64, k, dtype=np.uint64) for k in (both, n - both, m - both))
        left, right = (np.unique(np.concatenate([shared, rest])) for rest in (one, other))
        bound = most_common(fine_ranges(left), fine_ranges(right))
        assert both <= bound <= min(n, m) and bound == most_common(fine_ranges(right), fine_ranges(left))
    # N-grams that agree in their lowest bits take more ranges, not fuller ones.
    alike = np.arange(600, dtype=np.uint64) << np.uint64(12)
    assert fine_ranges(alike).sum(dtype=int) == 600


def test_ngram_join_splits_crowded_keys(documents, monkeypatch):
    from placetime.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", 200)
    rng = random.Random(1)
    base = split(made_up(rng, 60))
    rows = []
    for i in range(60):
        text = list(base)
        text[rng.randrange(60)] = f"w{i}"
        rows.append((i, " ".join(text)))
    got = jaccard_components(documents(rows), 3, 90).collect()
    assert sorted((False, r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(rows, 3, 90)
    assert jaccard_components(documents(rows).limit(0), 3, 90).count() == 0


@pytest.mark.parametrize("block", [200, 1 << 18])
def test_ngram_join_counts_every_link(documents, monkeypatch, block):
    from placetime.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_NGRAMS", block)
    rng = random.Random(7)
    base = split(made_up(rng, 60))
    rows = [(1, None), (2, " "), (3, "alone here"), (None, " ".join(base)), (4, "short text"), (5, "SHORT text"), (5, "another one")]
    for i in range(40):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(60)] = f"w{rng.randint(0, 9)}"
        rows += [(100 + i, " ".join(text))] * rng.choice([1, 1, 1, 3])

    def grams(text):
        w = split((text or "").lower())
        return {tuple(w[k : k + 3]) for k in range(max(len(w) - 2, min(1, len(w))))}

    sets = [(i, grams(t)) for i, t in rows]
    want = []
    for k, (i, s) in enumerate(sets):
        others = [t for m, (j, t) in enumerate(sets) if m != k and None not in (i, j) and s and t]
        want.append((i or 0, len(s), sum(100 * len(s & t) >= 90 * len(s | t) for t in others)))
    got = jaccard_components(documents(rows).repartition(3), 3, 90).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"], r["n_links"]) for r in got) == sorted(want)
    assert max(n for _, _, n in want) > 10


# --- 2 line dedup ----------------------------------------------------------------------------------------


def test_line_dedup_of_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "a b\nc d"), (2, "a b\ne")], "doc_id long, text string")
    rows = rows.selectExpr("*", "1 as _gone", "2 as _near", "3 as _d", "4 as _t", "5 as _h", "6 as _lines", "7 as n_lines", "8 as row", "9 as id", "10 as hash", "11 as gone", "12 as lines")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(rows).collect()}
    assert [got[2][c] for c in ("clean_text", "n_lines", "_gone", "_h", "row", "id", "gone", "lines")] == ["e", 2, 1, 5, 8, 9, 11, 12]
    assert sorted(line_dedup.dedup_lines(rows).columns) == sorted({*rows.columns, "n_dropped", "n_near", "clean_text"})


def test_copies_are_left_whole(documents):
    """A copy keeps the lines it takes from its original and loses what that lost too; holders of a few repeated lines lose them."""
    rng = random.Random(21)
    lines = [made_up(rng, 12, "abcdefgh") for _ in range(30)]
    footer = "the same old footer line on all pages"
    rows = [(0, footer), (1, "\n".join([*lines[:6], footer])), (2, "\n".join([*lines[:6], footer])), (3, "\n".join([*lines[:5], made_up(rng, 12, "xyz"), footer]))]
    rows += [(4, "\n".join([lines[0], *lines[10:14], footer])), (5, "\n".join([lines[1], lines[11]])), (None, "\n".join(lines[:6])), (6, None), (7, "")]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(rows), copies=0.5).collect()}
    text = dict(rows)
    whole = "\n".join(lines[:6])
    assert got[0]["clean_text"] == footer and got[1]["clean_text"] == got[2]["clean_text"] == got[None]["clean_text"] == whole
    assert got[3]["clean_text"] == "\n".join(text[3].split("\n")[:6]) and got[3]["n_dropped"] == 1
    assert got[4]["clean_text"] == "\n".join(lines[10:14]) and got[4]["n_dropped"] == 2
    assert got[6]["clean_text"] is None and got[7]["clean_text"] == ""
    # Half of it comes from one document and half from another one; the later one counts as its original.
    assert got[5]["n_dropped"] == 1
    plain = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup_lines(documents(rows)).collect()}
    assert (plain[2], plain[3], plain[None]) == (7, 6, 6)


def brute_lines(rows, min_words, near_words):
    occurrences = []
    for i, text in rows:
        for k, line in enumerate((text or "").split("\n")):
            w = tuple(split(line))
            if len(w) >= min_words:
                occurrences.append(((i is None, i, k), w))

    def near(a, b):
        if min(len(a), len(b)) < near_words:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:j] + b[j + 1 :] == a for j in range(len(b)))

    gone = {}
    for at, w in occurrences:
        for other, v in occurrences:
            if other < at and (v == w or near(v, w)):
                gone[at[1], at[2]] = True
                break
    return gone


def test_line_dedup_against_brute_force(documents):
    rng = random.Random(3)
    pool = [split(made_up(rng, rng.choice([3, 5, 9, 10, 11, 14]))) for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "\n \n"), (500, "a b\na b\n" + "c " * 3000)]
    for i in range(10, 60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                kind, at = rng.choice("ird"), rng.randrange(len(line))
                line[at : at + (kind != "i")] = [] if kind == "d" and len(line) > 1 else [rng.choice("xyz")]
            lines.append((rng.choice([" ", "\t", "  "])).join(line))
        rows.append((i, "\n".join(lines)))
    gone = brute_lines(rows, 5, 10)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(rows).repartition(4), 5, 10).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [line for k, line in enumerate(lines) if (i, k) not in gone]
        dropped = len(lines) - len(kept)
        assert got[i]["n_dropped"] == dropped, i
        if text is None:
            assert got[i]["clean_text"] is None
        elif dropped:
            assert got[i]["clean_text"] == ("\n".join(kept) if any(split(x) for x in kept) else "")
        else:
            assert got[i]["clean_text"] == text
    assert any(r["n_near"] for r in got.values())


def test_line_dedup_template_lines_copies_and_empty(documents):
    line = "this is page {} of the long report on many things"
    rows = [(i, line.format(i)) for i in range(40)] + [(7, line.format(7)), (None, line.format("none"))]
    got = line_dedup.dedup_lines(documents(rows)).collect()
    assert sum(r["n_dropped"] for r in got) == 41
    assert [r["doc_id"] for r in got if not r["n_dropped"]] == [0]
    assert line_dedup.dedup_lines(documents(rows).limit(0)).count() == 0
    assert set(got[0].asDict()) >= {"doc_id", "text", "lang", "source", "n", "size"}


def test_line_dedup_takes_short_lines(documents):
    """By default every line with a word counts when equal, and from 5 words on when near."""
    rng = random.Random(4)
    pool = [split(made_up(rng, rng.choice([1, 2, 4, 5, 6, 8]))) for _ in range(14)]
    rows = [(0, "}\n \n}"), (1, "a b\n\nthe end\na  b"), (2, "one two three four five"), (3, "one two three four six")]
    rows += [(4, "read on"), (5, "read  on"), (6, "read of")]
    for i in range(10, 50):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = list(rng.choice(pool))
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = rng.choice("xyz")
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    gone = brute_lines(rows, 1, 5)
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(documents(rows).repartition(4)).collect()}
    for i, text in rows:
        kept = [line for k, line in enumerate(text.split("\n")) if (i, k) not in gone]
        assert got[i]["n_dropped"] == len(text.split("\n")) - len(kept), i
        assert got[i]["clean_text"] == ("\n".join(kept) if any(split(x) for x in kept) else ""), i
    assert (got[0]["n_dropped"], got[3]["n_near"], got[5]["clean_text"], got[6]["n_dropped"]) == (1, 1, "", 0)


# --- 1 token counts --------------------------------------------------------------------------------------


def test_edits_keep_counts_exact(vocabulary):
    rng = random.Random(8)
    encoder = ByteBpe(vocabulary("byte_bpe_50k.json"))
    alphabet = ["a", "b", " ", " ", "\n", "  ", "é", "1", ".", "'s", "\xa0", "word", "日"]
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))
        tree = token_counts.build(text, encoder, leaf_words=3)
        assert tree.total == len(encoder.ids(text))
        edits, at = [], 0
        for _ in range(rng.randint(0, 4)):
            start = rng.randint(at, len(text))
            end = rng.randint(start, min(len(text), start + 12))
            edits.append((start, end, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6)))))
            at = end
        want, at = "", 0
        for start, end, new in sorted(edits):
            want += text[at:start] + new
            at = end
        want += text[at:]
        after, tree, encoded = token_counts.edit(text, tree, edits, encoder, leaf_words=3)
        assert after == want
        assert tree.total == len(encoder.ids(want)) == tree.tokens.sum()
        assert int(tree.chars.sum()) == len(want)


def test_only_touched_leaves_are_encoded(vocabulary):
    encoder = ByteBpe(vocabulary("byte_bpe_50k.json"))
    text = " ".join(f"word{i}" for i in range(10_000))
    tree = token_counts.build(text, encoder)
    after, tree, encoded = token_counts.edit(text, tree, [(40_000, 40_001, "Q")], encoder)
    assert encoded < 2000 and tree.total == len(encoder.ids(after))


def test_recounted_table(spark, documents, vocabulary):
    path = vocabulary("byte_bpe_50k.json")
    rows = [(1, None), (2, ""), (3, "a b\na b\nmail me@x.org or +1 222 333 4444 now"), (3, "other text"), (3, "other text"), (None, "q r\nq r"), (5, "z " * 5000)]
    docs = documents(rows)
    edits = token_counts.cleaning_edits(docs)
    got = sorted(token_counts.recounted(docs, edits, path).collect(), key=str)
    assert len(got) == len(rows)
    encoder = ByteBpe(path)
    assert [r["n_tokens_after"] for r in got if r["n_edits"]] == [len(encoder.ids("a b\nmail <mail> or <number> now"))]
    assert sorted(r["n_tokens"] for r in got) == sorted(len(encoder.ids(t or "")) for _, t in rows)
    odd = spark.createDataFrame([(2, None, None, None, "x"), (99, 5, 0, 1, "x")], "doc_id long, text_hash long, start long, end long, replacement string")
    assert all(r["n_edits"] == 0 for r in token_counts.recounted(docs, odd, path).collect())


# --- 8 fertility -----------------------------------------------------------------------------------------


def brute_base(text):
    w = split(text)
    lines = [x for x in (text or "").split("\n") if split(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    marked = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 5)}
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(marked))


def test_fertility_counts_and_verdicts(documents, vocabulary):
    rng = random.Random(4)
    rows = [(1, None), (2, ""), (3, "a\na\n \n a\nb #é|"), (4, "a b c d e f a b c d e f g"), (5, "ab " * 12), (6, "A b c d e f a b c d e f g")]
    rows += [(10 + i, made_up(rng, rng.randint(8, 60), "ab"), "xx") for i in range(30)]
    rows += [(50 + i, made_up(rng, 200, "etaoinshr"), "en" if i % 2 else "q1") for i in range(40)]
    rows += [(99, " ".join(f"{w}%%%" for w in split(made_up(rng, 300, "etaoinshr"))))]
    measured = fertility.measures(documents(rows), vocabulary("piece_bpe_32k.model"))
    measured = Tables(measured.sparkSession, "t").settle(measured)
    got = {r["doc_id"]: r for r in fertility.judged(measured, fertility.bands(measured)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        r = got[i]
        counts = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])
        assert counts == brute_base(text), i
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and r["fertility_failed"] is None)
    assert all(got[50 + i]["kept"] for i in range(40)) and not got[99]["kept"]
    assert got[50]["band_key"] == "Latin" and got[51]["band_key"] == "en"
    empty = fertility.measures(documents(rows).limit(0), vocabulary("piece_bpe_32k.model"))
    assert fertility.judged(empty, fertility.bands(empty)).count() == 0


# --- 6 toxicity ------------------------------------------------------------------------------------------


def test_grammar_weighs_clauses():
    from placetime.llm.words import text_hash

    machine = toxicity.Transducers(toxicity.Grammar({}, {}, ()))

    def clause(text):
        return machine.clause([(text_hash(w), 3.0 if w in toxicity.INSULTS else 0.0) for w in text.split()])

    assert clause("you are an idiot") > clause("what an idiot") > clause("he is not an idiot") > 0
    assert clause("someone said idiot") < clause("what an idiot")
    assert clause("i will kill you") > 0 and clause("plants kill weeds") == 0 and clause("fine words") == 0


def test_toxicity_learns_unknown_words(spark, documents):
    rng = random.Random(6)
    rows, labels = [(1, None), (2, ""), (3, "x " * 3000)], [(3, 0), (2, None)]
    for i in range(600):
        text, toxic = split(made_up(rng, 40, "abcdefgh")), i % 6 == 0
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(["zorgla", "zorglix", "zorglon", "grimp"]))
        rows.append((100 + i, " ".join(text)))
        if i < 400:
            labels.append((100 + i, int(toxic)))
    docs = documents(rows)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar = toxicity.learn(docs, table)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, grammar).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert all((got[100 + i] >= 0.7) == (i % 6 == 0) for i in range(600))
    assert got[1] == got[2] < 0.3
    assert toxicity.score(docs.limit(0), toxicity.learn(docs, table.limit(0))).count() == 0


# --- 9 mixing --------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in order}
        above = {s for s in free if target[s] > most * sizes[s] * (1 + 1e-12)}
        if not above:
            return target
        capped |= above


def test_mixing_meets_targets(documents):
    rng = random.Random(9)
    rows = [(1, None, "en", "a"), (2, "", "en", "b"), (3, "w " * 4000, "en", "b"), (4, "x y", "en", "tiny"), (5, "q " * 9, "en", None), (None, "r s t", "en", "a")]
    rows += [(100 + i, made_up(rng, rng.randint(1, 80)), "en", rng.choice(["a", "a", "a", "b", "c", "Z"])) for i in range(600)]
    rows += [rows[10], rows[10]]
    docs = documents(rows)
    got = mixing.mix(docs.repartition(5)).collect()
    again = mixing.mix(docs.repartition(2)).collect()
    key = lambda r: (str(r["doc_id"]), r["row_hash"], r["copies"], r["rate"])
    assert [key(r)[:3] for r in sorted(got, key=key)] == [key(r)[:3] for r in sorted(again, key=key)]
    assert len(got) == len(rows)
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(split(text))
    want = brute_targets(sizes)
    for source in sizes:
        mine = [r for r in got if r["source"] == source]
        assert all(r["source_size"] == sizes[source] and r["target"] == pytest.approx(want[source]) for r in mine)
        taken = sum(r["copies"] * r["size"] for r in mine)
        assert abs(taken - want[source]) <= max(r["size"] for r in mine)
        if 0 < want[source] < 3 * sizes[source]:
            assert sum(r["rate"] * r["size"] for r in mine) == pytest.approx(want[source], rel=1e-5)
    assert all(0 <= r["copies"] <= 3 for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


# --- 10 licenses -----------------------------------------------------------------------------------------


def brute_licenses(text, threshold=80):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, base = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k : k + len(p)] == p:
                at.append(k)
                base.add(label)
    more, best = set(), 0.0
    for line in low.split("\n"):
        have = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", line))
        for label, notice in licenses.TEMPLATES.items():
            need = set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", notice.lower()))
            if 100 * len(need & have) >= threshold * len(need):
                more.add(label)
                best = max(best, len(need & have) / len(need))
    return (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if at else best)


def test_licenses_against_brute_force(documents):
    rng = random.Random(10)
    rows = [(1, None), (2, ""), (3, "MIT license mit LICENSE, mit-license"), (3, "cc BY"), (4, "cc  by apache\nlicense gnu general public license"), (5, "gnu mit license" * 2), (None, "Apache License"), (6, "the " * 4000)]
    notices = list(licenses.TEMPLATES.values())
    for i in range(60):
        notice = split(rng.choice(notices))
        cut = [w for w in notice if rng.random() > rng.choice([0, 0.1, 0.25])]
        rng.shuffle(cut)
        rows.append((10 + i, made_up(rng, 5) + "\n" + " ".join(cut + split(made_up(rng, rng.randint(0, 40)))) + "\nthe end of the license"))
    got = licenses.scan(documents(rows).repartition(3)).collect()
    columns = "n_words n_base first_word last_word base_labels labels score".split()
    mine = sorted((str(r["doc_id"]), *map(str, (r[c] for c in columns))) for r in got)
    assert mine == sorted((str(i), *map(str, brute_licenses(t))) for i, t in rows)
    assert any("notice" in r["labels"] for r in got)
    assert licenses.scan(documents(rows).limit(0)).count() == 0


def brute_license_runs(text, threshold=80):
    """As `brute_licenses`, with every run of words no longer than 5/4 of the template in place of lines, and whole license texts."""
    def plain(x):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower())

    w, notices = plain(text or ""), {label: plain(notice) for label, notice in {**licenses.TEMPLATES, **licenses.TEXTS}.items()}
    best = {}
    for label, notice in notices.items():
        run = 5 * len(notice) // 4
        held = max(len(set(notice) & set(w[i : i + run])) for i in range(max(len(w) - run, 0) + 1))
        if 100 * held >= threshold * len(set(notice)):
            best[label] = held / len(set(notice))
    return best


def test_licenses_across_line_ends(documents):
    rng = random.Random(11)
    rows = [(1, None), (2, ""), (3, "the " * 4000)]
    every = {**licenses.TEMPLATES, **licenses.TEXTS}
    for label, notice in every.items():
        for width, start in ((5, ""), (12, " * "), (9, "# ")):
            w = split(notice)
            wrapped = "\n".join(start + " ".join(w[i : i + width]) for i in range(0, len(w), width))
            rows.append((100 + len(rows), made_up(rng, rng.randint(0, 150)) + "\n" + wrapped + "\n" + made_up(rng, rng.randint(0, 150))))
        # All words of a template, but nowhere together.
        rows.append((100 + len(rows), " ".join(x + " " + made_up(rng, 9, "xyz") for x in split(notice))))
        cut = [x for x in split(notice) if rng.random() > 0.15]
        rows.append((100 + len(rows), "\n".join(split(made_up(rng, 40)) + cut)))
    got = {r["doc_id"]: r for r in licenses.scan(documents(rows).repartition(3), templates=every, across_lines=True).collect()}
    for i, text in rows:
        base, best = brute_licenses(text)[4], brute_license_runs(text)
        assert got[i]["labels"] == ",".join(sorted({*base.split(","), *best} - {""})), text
        assert got[i]["score"] == (1.0 if base else max(best.values(), default=0.0))
    wrapped = [r for r in got.values() if "mit-notice" in r["labels"].split(",")]
    assert len(wrapped) >= 3 and all(r["score"] > 0 for r in wrapped)
    assert licenses.scan(documents(rows).limit(0), across_lines=True).count() == 0


def test_phrases_may_overlap_and_columns_clash(spark):
    rows = spark.createDataFrame([(1, "a b c a b"), (2, "A  B"), (3, None), (4, "a")], "doc_id long, text string")
    rows = rows.selectExpr("*", "5 as n_words", "'x' as words", "'y' as each", "'z' as places", "1 as _n", "2 as _hits")
    got = {r["doc_id"]: r for r in licenses.phrase_hits(rows, {"a b": "first", "b c": "second", "a b c a": "third"}).collect()}
    assert [got[1][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "words", "_n")] == [5, 4, 0, 3, ["first", "second", "third"], "x", 1]
    assert [got[i]["n_base"] for i in (2, 3, 4)] == [1, 0, 0] and got[3]["first_word"] is None


# --- 4 co-training ---------------------------------------------------------------------------------------


def test_text_view_tells_words_apart(spark, documents):
    """Bad texts of the same shape and layout as good ones are told by their words; repeated rows count each."""
    rng = random.Random(13)
    good, bad = ([made_up(rng, 1, "etaoinshr") for _ in range(40)] for _ in range(2))
    rows = [(i, " ".join(rng.choices(good if i % 2 else bad, k=50)), "en", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in cotraining.classify(documents(rows), labels, rounds=1).collect()}
    assert sum((got[i]["score"] >= 0.5) == (i % 2 == 1) for i in range(120, 400)) >= 0.95 * 280
    twice = cotraining.classify(documents(rows + rows[:3]), labels, rounds=1).collect()
    assert len(twice) == 403 and sum(r["doc_id"] == 1 for r in twice) == 2


def test_newton_steps_are_those_of_a_plain_fit(spark, documents):
    """The summed steps give the coefficients of a ridge fit in memory."""
    rng = random.Random(14)
    rows = [(i, made_up(rng, rng.randint(3, 40), "abcde" if i % 3 else "cdefg"), "en", f"s{i % 5}") for i in range(200)]
    viewed = cotraining.views(documents(rows)).join(
        spark.createDataFrame([(i, float(i % 3 == 0)) for i in range(200)], "doc_id long, label double"), "doc_id"
    ).cache()
    quality = cotraining.train(viewed, rounds=0)
    x, y = (np.array([np.frombuffer(r["text_view"], "<f4") for r in viewed.collect()], float), np.array([r["label"] for r in viewed.collect()]))
    middle, spread = x.mean(axis=0), np.sqrt(np.maximum(x.var(axis=0), 1e-8))
    design, beta = np.column_stack([np.ones(len(y)), np.clip((x - middle) / spread, -8, 8)]), np.zeros(x.shape[1] + 1)
    measures = len(cotraining.TEXT_VIEW)
    penalty = np.array([1e-6, *[cotraining.RIDGE] * measures, *[cotraining.RIDGE * cotraining.BIN_RIDGE] * (x.shape[1] - measures)])
    for _ in range(cotraining.NEWTON_ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + np.diag(penalty + 1e-9), design.T @ (y - p) - penalty * beta)
        step *= min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        beta = beta + step
        if np.abs(step).max() < 1e-3:
            break
    assert np.allclose(quality.text.beta, beta, atol=1e-4)


def test_cotraining_held_out(spark, documents):
    rng = random.Random(11)
    rows, labels = [(1, None), (2, ""), (3, "y " * 5000)], [(3, 0), (1, None)]
    for i in range(500):
        good = rng.random() < 0.7
        text = made_up(rng, 60, "etaoinshr").replace(" e", ".\ne")
        if not good:
            text = text.upper().replace(" ", "!! ").replace("\n", " ")
        rows.append((100 + i, text, "en", "good" if good else "bad"))
        if i < 60:
            labels.append((100 + i, int(good)))
    docs = documents(rows)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    got = {r["doc_id"]: r for r in cotraining.classify(docs, table, rounds=2).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got.values())
    right = sum((got[100 + i]["score"] >= 0.5) == (rows[3 + i][3] == "good") for i in range(60, 500))
    assert right >= 0.97 * 440
    assert cotraining.classify(docs.limit(0), table).count() == 0
    assert {r["score"] for r in cotraining.classify(docs, table.limit(0)).collect()} == {0.5}
