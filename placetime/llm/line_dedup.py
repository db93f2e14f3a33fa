"""Near-duplicate lines by a deletion-neighbourhood join, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placetime.llm.ordered import places
from placetime.llm.tables import Tables

BLANKS = r"[\x20\x09-\x0D]+"
AT = ["doc_id", "text_hash", "line_no"]


def _order(prefix: str = "") -> Column:
    """An occurrence's place in the corpus; rows without an id come last."""
    return F.struct(
        F.col(f"{prefix}doc_id").isNull().alias("no_id"), F.col(f"{prefix}doc_id").alias("doc_id"),
        F.col(f"{prefix}text_hash").alias("text_hash"), F.col(f"{prefix}line_no").alias("line_no"),
    )


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, line_no, line): every line of every whole text."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"),
    )


def _words(line: str = "line") -> Column:
    """A line's words joined by single blanks. Most lines are like that already, which a few searches tell."""
    odd = F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" "))
    for blank in ("  ", "\t", "\r", "\x0b", "\x0c"):
        odd = odd | F.contains(line, F.lit(blank))
    return F.when(odd, F.trim(F.regexp_replace(line, BLANKS, " "))).otherwise(F.col(line))


def _keyed(lines: DataFrame, min_words: int) -> DataFrame:
    """Adds n (words) and a 128-bit key of each line, and leaves out shorter lines."""
    lines = lines.withColumn("words", _words()).drop("line").filter("words <> ''")
    n = F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) + 1
    with_n = lines.withColumn("n", n).filter(F.col("n") >= min_words)
    return with_n.withColumn("h1", F.xxhash64("words")).withColumn("h2", F.xxhash64(F.lit("second"), "words"))


HALVES = ["half1", "half2", "half3", "half4"]


def _halves(near_words: int) -> list[Column]:
    """Keys of a line's halves. Two lines that differ by one word inserted, deleted or replaced agree in the
    first half or in the rest, halves being those of the shorter one; so a line of n words gives the
    halves for n and for n - 1 words, each under the number it was cut for. Lines of fewer than
    `near_words` words have none."""
    keys = []
    for n in ("n", "(n - 1)"):
        keys.append(F.expr(f"xxhash64('head', {n}, substring_index(words, ' ', cast({n} div 2 as int)))"))
        keys.append(F.expr(f"xxhash64('tail', {n}, substring_index(words, ' ', -cast({n} - {n} div 2 as int)))"))
    return [F.when(F.col("n") >= near_words, key).alias(name) for key, name in zip(keys, HALVES)]


def repeated_lines(
    docs: DataFrame, min_words: int = 1, near_words: int = 5, id_col: str = "doc_id", text_col: str = "text", origins: bool = False
) -> DataFrame:
    """(doc_id, text_hash, line_no, near) of every line that repeats an earlier line of the corpus; with
    `origins` also its number of words and `origin`, the document and text hash of the earlier line.

    A line repeats an earlier one if their words are the same, or if both have `near_words` words or more
    and one word inserted, deleted or replaced makes them the same (`near`): the edit bound is one word in
    `near_words`, so shorter lines have a bound of none and repeat when equal. A line with fewer than
    `min_words` words repeats nothing. Earlier is by document id (null last), hash of the text and line number.

    1. Lines with equal words are one, at the earliest place; that combines map side.
    2. Only lines that share a half with another one can be near; they alone go on, under a number
       in the order of their places.
    3. Of these, every variant with one word deleted is emitted as a hashed key with the line's number and
       the place of the word. Lines with the same variant at the same place differ by one replaced word:
       per key the earliest is found. A line whose own key is a variant of a longer one differs
       from it by one inserted word: such keys are aggregated to the earliest on either side.
       So a key gives one candidate per line, however many lines share it, and no pairs.
    4. Candidates are verified on the words themselves.
    """
    tables = Tables(docs.sparkSession, "line-dedup")
    lines = _keyed(lines_of(docs, id_col, text_col), min_words)
    occurrence = tables.settle(lines.select("h1", "h2", *AT, *(["n"] if origins else []), *_halves(near_words)))
    firsts = occurrence.groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.max(_order()).alias("last"))
    firsts = tables.settle(firsts.select("h1", "h2", "first", (F.col("first") != F.col("last")).alias("again")))

    # Lines that share a half with another line.
    halves = occurrence.select(F.explode(F.array(*HALVES)).alias("half"), "h1").filter(F.col("half").isNotNull())
    shared = halves.groupBy("half").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).filter("a <> b").select("half")
    shared = tables.settle(shared)
    close = tables.settle(halves.join(shared, "half", "left_semi").select("h1").distinct())
    wanted = firsts.join(close, "h1", "left_semi").select(
        "h1", "h2", F.col("first.doc_id").alias("d"), F.col("first.text_hash").alias("t"), F.col("first.line_no").alias("l")
    )
    wanted = tables.settle(wanted)
    # Their words are read at the earliest place alone.
    there = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")) & (F.col("line_no") == F.col("l"))
    chosen = lines_of(docs, id_col, text_col).join(wanted, there).withColumn("words", _words()).dropDuplicates(["h1", "h2"])
    chosen = tables.settle(chosen.select(F.lit(0).alias("all"), *AT, "words"))
    order = [F.col("doc_id").isNull().asc(), *(F.col(name).asc() for name in AT)]
    chosen = tables.settle(places(chosen, "all", order, tables).select(F.col("index").alias("id"), *AT, "words"))
    near = _verified(chosen, _candidates(chosen, tables)).groupBy("id").agg(F.min("earlier").alias("earlier"))

    # A first occurrence goes if an earlier line is near; all others go.
    gone = chosen.join(near, "id")
    if origins:
        earlier = chosen.select(F.col("id").alias("earlier"), F.struct("doc_id", "text_hash").alias("origin"))
        gone = gone.join(earlier, "earlier").withColumn("n", F.size(F.split("words", " ")))
    more = ["n", "origin"] if origins else []
    gone = tables.settle(gone.select(*AT, F.lit(True).alias("near"), *more))
    exact = occurrence.select("h1", "h2", _order().alias("at"), *more[:1]).join(firsts.filter("again").select("h1", "h2", "first"), ["h1", "h2"])
    exact = exact.filter("at <> first")
    if origins:
        # A line whose first occurrence is near to an earlier line comes from there.
        moved = gone.select(_order().alias("first"), F.col("origin").alias("before"))
        exact = exact.join(moved, "first", "left").withColumn("origin", F.coalesce("before", F.struct("first.doc_id", "first.text_hash")))
    exact = exact.select("at.doc_id", "at.text_hash", "at.line_no", F.lit(False).alias("near"), *more)
    repeated = exact.unionAll(gone).groupBy(*AT).agg(F.min("near").alias("near"), *(F.min(c).alias(c) for c in more))
    repeated = tables.settle(repeated)
    tables.drop(occurrence, firsts, shared, close, wanted, chosen, gone)
    return repeated


def _candidates(chosen: DataFrame, tables: Tables) -> DataFrame:
    """(id, earlier, place): a line, an earlier one that it may be near to, and the place of the word of
    the longer line (or of both) that differs."""
    # Lines go to their tasks before they are laid out as words, and stay there.
    words = chosen.repartition("id").select("id", F.posexplode(F.split("words", " ")).alias("place", "word"))
    line = Window.partitionBy("id")
    so_far = line.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    # Hashes of a line and of it without this word, as words are hashed with their places.
    kept, moved = F.xxhash64("word", "place"), F.xxhash64("word", F.col("place") - 1)
    before = F.bit_xor(kept).over(so_far).bitwiseXOR(kept)
    after = F.bit_xor(moved).over(line).bitwiseXOR(F.bit_xor(moved).over(so_far))
    whole = F.when(F.col("place") == 0, F.bit_xor(kept).over(line))
    variants = tables.settle(words.select(before.bitwiseXOR(after).alias("key"), "place", "id", whole.alias("whole")))

    # Replaced words: same place, same rest. The earliest of them stands for all earlier ones.
    same = variants.groupBy("key", "place").agg(F.min("id").alias("earlier"), F.max("id").alias("last"))
    same = tables.settle(same.filter("earlier <> last").drop("last"))
    replaced = variants.join(same, ["key", "place"]).filter("earlier < id").select("id", "earlier", "place")

    # Inserted words: a shorter line is a variant of a longer one; a variant meets one line at most.
    shorter = variants.filter(F.col("whole").isNotNull()).select(F.col("id").alias("short"), F.col("whole").alias("key"))
    pairs = tables.settle(variants.join(shorter, "key").select("id", "short", "place"))
    deleted = pairs.filter("short < id").select("id", F.col("short").alias("earlier"), "place")
    earliest = pairs.filter("id < short").groupBy("short").agg(F.min(F.struct("id", "place")).alias("e"))
    inserted = earliest.select(F.col("short").alias("id"), F.col("e.id").alias("earlier"), F.col("e.place").alias("place"))
    found = tables.settle(replaced.unionAll(deleted).unionAll(inserted).dropDuplicates(["id", "earlier"]))
    tables.drop(variants, same, pairs)
    return found


def _verified(chosen: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates whose words differ by one edit at the place found."""
    words = F.split("words", " ")
    one, other = chosen.select("id", words.alias("w1")), chosen.select(F.col("id").alias("earlier"), words.alias("w2"))
    both = candidates.join(one, "id").join(other, "earlier")

    def without(words: str) -> Column:
        head = F.slice(words, F.lit(1), F.col("place"))
        return F.concat(head, F.slice(words, F.col("place") + 2, F.size(words)))

    n1, n2 = F.size("w1"), F.size("w2")
    same = (n1 == n2) & (without("w1") == without("w2"))
    longer = (n1 == n2 + 1) & (without("w1") == F.col("w2"))
    shorter = (n2 == n1 + 1) & (F.col("w1") == without("w2"))
    return both.filter(same | longer | shorter)


RESULTS = ("n_lines", "n_dropped", "n_near", "clean_text")


def _spared(gone: DataFrame, copies: float, total: Column) -> tuple[DataFrame, Column, Column]:
    """(lines that go, by document, and the columns `gone` and `near`) if copies of a document are left to a later stage."""
    by_origin = gone.groupBy("doc_id", "text_hash", "origin").agg(
        F.sum("n").alias("words"), F.collect_list("line_no").alias("lines"), F.sum(F.col("near").cast("long")).alias("near")
    )
    part = F.struct(F.col("words"), F.col("origin"), F.col("lines"), F.col("near"))
    # The largest part is the last one; of equal ones the one from the later document.
    per_doc = by_origin.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    main, others = F.element_at("parts", -1), F.slice("parts", F.lit(1), F.size("parts") - 1)
    elsewhere = F.aggregate(others, F.lit(0).cast("long"), lambda n, p: n + p["words"])
    copy = main["words"] >= copies * (total - elsewhere)
    going = F.when(F.col("parts").isNotNull(), F.when(copy, others).otherwise(F.col("parts")))
    near = F.aggregate(going, F.lit(0).cast("long"), lambda n, p: n + p["near"])
    lines = F.flatten(F.transform(going, lambda p: p["lines"]))
    return per_doc, F.when(F.size(lines) > 0, lines), near


def dedup_lines(
    docs: DataFrame, min_words: int = 1, near_words: int = 5, id_col: str = "doc_id", text_col: str = "text", copies: float | None = None
) -> DataFrame:
    """`docs` with n_lines, n_dropped, n_near and clean_text: whole texts without the lines that an earlier
    line repeats (see `repeated_lines`). A text of which no line with a word is left becomes "".

    With `copies`, a share of words, a document that takes so much of its text from one earlier document is a copy as
    a whole: it keeps these lines and loses only those that come from elsewhere, as the earlier
    document lost them too. So a later stage finds copies next to what they are copies of, instead of their remains.

    Other columns are kept as they are, whatever their names; columns called like a result give way to it. Null
    texts stay null and have no lines, as empty ones. Texts and lines of any length are taken whole.
    Rows alike in id and text are one document: each keeps the same lines. Rows that share an id
    but not the text are told apart, and rows without an id come last. An empty table gives no rows.
    """
    tables = Tables(docs.sparkSession, "line-dedup")
    kept_columns = [c for c in docs.columns if c not in RESULTS]
    row = F.struct(*[F.col(f"`{c}`") for c in kept_columns]).alias("row")
    text = F.col("row").getField(text_col)
    rows = docs.select(row, F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("hash"))
    repeated = repeated_lines(docs, min_words, near_words, id_col, text_col, origins=copies is not None)
    if copies is None:
        per_doc, gone, near = repeated.groupBy("doc_id", "text_hash").agg(
            F.collect_list("line_no").alias("gone"), F.sum(F.col("near").cast("long")).alias("near")
        ), F.col("gone"), F.col("near")
    else:
        words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
        per_doc, gone, near = _spared(repeated, copies, words)
    per_doc = tables.settle(per_doc)
    joined = rows.join(per_doc, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left")
    joined = joined.withColumn("text", text).withColumn("lines", F.split("text", "\n"))
    joined = joined.withColumn("found", near).withColumn("gone", gone)
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    kept = F.transform(left, lambda i: F.element_at("lines", i + 1))
    any_word = F.exists(kept, lambda line: F.trim(F.regexp_replace(line, BLANKS, " ")) != "")
    clean = F.when(F.col("gone").isNull(), F.col("text")).when(any_word, F.array_join(kept, "\n")).otherwise("")
    n_lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size("lines")).cast("long")
    results = F.struct(
        n_lines.alias("n_lines"), F.coalesce(F.size("gone").cast("long"), F.lit(0)).alias("n_dropped"),
        F.coalesce("found", F.lit(0)).cast("long").alias("n_near"), clean.alias("clean_text"),
    )
    return joined.select("row", results.alias("results")).select("row.*", "results.*")
