"""The Merkle manifest against a plain tree in memory."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from placetime.llm import merkle
from placetime.llm.ordered import places
from placetime.llm.tables import Tables


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """(root, steps of each leaf as (digests before, digests after))."""
    steps = [[] for _ in leaves]
    nodes = [(value, [at]) for at, value in enumerate(leaves)]
    while len(nodes) > 1:
        above = []
        for start in range(0, len(nodes), 3):
            run = nodes[start : start + 3]
            for at, (_, below) in enumerate(run):
                for item in below:
                    steps[item].append(([v for v, _ in run[:at]], [v for v, _ in run[at + 1 :]]))
            above.append((digest("".join(v for v, _ in run)), [i for _, below in run for i in below]))
        nodes = above
    return nodes[0][0], steps


def test_sweeps_of_a_block():
    for n in range(1, 60):
        leaves = [digest(str(i)) for i in range(n)]
        root, steps = tree(leaves)
        level, got, runs = merkle.forward(leaves)
        assert got == root and level == len(steps[0])
        paths = merkle.backward(runs, level, "")
        for at, own in enumerate(steps):
            assert paths[at] == "".join(f"{''.join(a)}*{''.join(b)}/" for a, b in own)
            value = leaves[at]
            for step in paths[at].split("/")[:-1]:
                value = digest(step.replace("*", value))
            assert value == root


def expected(rows):
    """Rows (doc_id, source, lang, n_chars, text) with leaf, siblings, subroot and root."""
    groups = defaultdict(list)
    for row in rows:
        groups[row[1]].append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below, out = {}, []
    for name in names:
        own = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        below[name] = own, *tree([leaf(r) for r in own])
    root, tops = tree([below[name][1] for name in names])
    for name, top in zip(names, tops):
        own, subroot, steps = below[name]
        for row, low in zip(own, steps):
            siblings = "".join("".join(a + b) for a, b in low + top)
            out.append((row[0], leaf(row), subroot, root, siblings))
    return sorted(out, key=repr)


def made(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    return df.selectExpr("*", "'t' as tree", "1 as index", "2 as level", "3 as digest", "4 as block", "5 as path", "6 as root", "7 as total")


def check(spark, rows):
    proofs = merkle.manifest(made(spark, rows).repartition(5))
    back = merkle.folded(F.col("leaf"), F.col("path"))
    got = proofs.select("doc_id", "leaf", "subroot", "root", merkle.siblings(F.col("path")).alias("s"), back.alias("back")).collect()
    assert all(row["back"] == row["root"] for row in got)
    assert sorted((tuple(row)[:5] for row in got), key=repr) == expected(rows)


def test_many_rows_of_one_source_and_a_few_of_others(spark):
    rng = random.Random(11)
    rows = [(i, "hot", "en", i, f"text {i}\n") for i in range(900)]  # more than a block, the last one in part
    rows += [(1000 + i, f"s{rng.randint(0, 6)}é", None, None, "x" * rng.randint(0, 9)) for i in range(60)]
    rng.shuffle(rows)
    check(spark, rows)


def test_nulls_empty_long_and_repeated_rows(spark):
    rows = [(1, None, None, None, None), (1, None, None, None, ""), (None, "", "en", 0, "a\nb"), (None, "", "en", 0, "a\nb")]
    rows += [(7, "b", "de", 5, "é" * 200_000), (7, "b", "de", 5, "é" * 200_000), (7, "b", "de", 6, "x"), (-3, "a", None, 1, "\n\n")]
    check(spark, rows)


def test_block_sizes_at_their_edges(spark):
    block = merkle.ARITY**merkle.LEVELS
    for n in (1, block, block + 1, 2 * block + 3):
        check(spark, [(i, "s", None, None, str(i)) for i in range(n)])


def test_every_source_a_row(spark):
    check(spark, [(i, f"s{i}", None, None, "t") for i in range(300)])


def test_empty_table(spark):
    assert merkle.manifest(made(spark, [])).collect() == []


def test_a_changed_row_does_not_fold_to_the_root(spark):
    rows = [(i, "s", None, 1, f"a\n{i}") for i in range(10)]
    claimed = merkle.leaf([F.translate("text", "\n", "") if f == "text" else F.col(f) for f in merkle.FIELDS])
    proofs = merkle.manifest(made(spark, rows), carried={"claimed": claimed})
    assert proofs.filter(merkle.folded(F.col("claimed"), F.col("path")) == F.col("root")).count() == 0
    assert proofs.filter(merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 10


def test_places_spread_a_group_over_tasks(spark):
    rows = spark.range(1000).selectExpr("if(id % 10 = 0, null, 'g') as g", "id")
    tables = Tables(spark, "test")
    got = places(tables.settle(rows), "g", [F.col("id").desc()], tables)
    assert sorted(tuple(r) for r in got.filter("g is null").select("id", "index", "total").collect()) == [(990 - 10 * i, i, 100) for i in range(99, -1, -1)]
    assert [r[0] for r in got.filter("g = 'g'").orderBy("index").select("id").collect()] == [i for i in range(999, -1, -1) if i % 10]
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
