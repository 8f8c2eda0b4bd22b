"""Line deduplication by an exact set-similarity join, in DataFrame functions only.

Lines with one token set are one class.  Tokens are ordered by rarity, counted over all
texts.  Two sets of similarity 0.8 or more share a token among their rarest ones, so only
prefixes are joined, by token and class of length.  The joins apply the length filter, the
positional filter (what can still follow a shared token) and a parity bitmap (its bits bound
the number of tokens that only one set has).  All of them are semi joins: a set asks whether
there is such a set and never lists them, so a group of similar sets makes as many rows as
it has sets and prefix tokens.  The first join leaves the few sets that look similar to any
other; only their lines are read again, and the last join compares their whole token sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import LAST, SPACE, documents, release, settle, unpacked, whole_rows

SLOT_BITS = 16  # a bitmap of texts has so many words of 64 bits
RARITY_BITS = 16  # tokens are counted in so many hash buckets, which bounds the table of counts
LEAST_SIZE = 4  # smaller sets have no other set within 0.8
PARITY = ("parity_0", "parity_1")  # a bitmap of 128 bits, in which every token of the rarer half turns one over
MARKS = ("\t", "\r")  # tokens that no line has; their ranks part the tokens of the two words of the bitmap
PASSES = 2  # parts of the first prefix join that run one after another
STEP = 1.26  # from one class of length to the next; more than 1.25, so sets within 0.8 are at most one class apart


def tokens(line: Column) -> Column:
    return F.array_remove(F.split(line, SPACE), "")


def _spaced(text: Column, feeds: str = "") -> Column:
    """``text`` with a blank for each other white space but line feeds (or ``feeds`` too): a split at one character is the fastest."""
    return F.regexp_replace(text, rf"[\t\x0B\f\r{feeds}]", " ")


def _rarity(texts: DataFrame) -> tuple[Column, list[int]]:
    """A constant array: for each hash bucket the upper 5 bits of its tokens' ranks, by the octave of their number; and the ranks of ``MARKS``.

    All tokens of all texts are counted; the table has a fixed number of entries.  About a quarter
    of all tokens has ranks below the first mark, and as many have ranks between the two.
    """
    found = texts.select(F.explode(F.split(_spaced(F.col("text"), r"\n"), " ")).alias("w")).filter("w <> ''")
    counted = found.groupBy(F.xxhash64("w").bitwiseAND((1 << RARITY_BITS) - 1).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    every = texts.sparkSession.range(1 << RARITY_BITS).select(F.col("id").cast("int").alias("b"))
    dense = every.join(counted, "b", "left").select("b", F.coalesce("n", F.lit(0)).alias("n")).withColumn("level", F.least(F.round(F.log2(F.col("n") + 1)).cast("int"), F.lit(31)))
    row = dense.agg(
        F.sort_array(F.collect_list(F.struct("b", "level"))).getField("level").alias("levels"), F.percentile("level", F.array(F.lit(0.25), F.lit(0.5)), F.col("n")).alias("quarters"),
        F.array(*[F.xxhash64(F.lit(m)) for m in MARKS]).alias("hashes"),
    ).first()
    levels = row["levels"]
    for hashed, level in zip(row["hashes"], row["quarters"] or (0, 0), strict=True):
        levels[hashed & ((1 << RARITY_BITS) - 1)] = int(level)
    upper = [(level - 16) << 59 for level in levels]
    marks = sorted(upper[h & ((1 << RARITY_BITS) - 1)] | ((h & ((1 << 64) - 1)) >> 5) for h in row["hashes"])
    return F.split(F.lit(",".join(map(str, upper))), ",").cast("array<long>"), marks


def _lines(texts: DataFrame) -> DataFrame:
    """One row per line with tokens: its place, the key of its token set, its parity bitmap and its join prefix."""
    rarity, marks = _rarity(texts)
    low, high = (F.lit(m).cast("long") for m in marks)
    lines = texts.select("ord", "text_key", F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("line_no", "line"))
    # the test on the line keeps the filter from computing the set a second time
    lines = lines.filter(F.btrim("line") != "")

    def rank(hashed: Column) -> Column:
        """Rarity first, the hash settles ties; the same token has the same rank everywhere."""
        return F.coalesce(F.get(rarity, hashed.bitwiseAND((1 << RARITY_BITS) - 1).cast("int")).bitwiseOR(F.shiftrightunsigned(hashed, 5)), F.lit(0).cast("long"))

    words = F.array_remove(F.split(F.concat("line", F.lit(" " + " ".join(MARKS))), " "), "")
    ranks = F.transform(F.transform(words, lambda w: F.xxhash64(w)), rank)
    ranked = lines.select("ord", "text_key", "line_no", F.sort_array(F.array_distinct(ranks)).alias("ranks"))  # in order, with the marks
    ranked = ranked.select("*", F.array_position("ranks", low).cast("int").alias("low"), F.array_position("ranks", high).cast("int").alias("high"), (F.size("ranks") - 2).alias("n"))
    quarters = (F.slice("ranks", F.lit(1), F.col("low") - 1), F.slice("ranks", F.col("low") + 1, F.col("high") - F.col("low") - 1))  # a word of the bitmap each
    turned = lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int")))
    prefix = F.when(F.col("n") < LEAST_SIZE, F.lit(0)).otherwise(F.col("n") - F.expr("(4 * n + 4) div 5").cast("int") + 1)
    rarest = F.slice(F.array_remove(F.array_remove(F.slice("ranks", F.lit(1), prefix + 2), low), high), F.lit(1), prefix)
    return ranked.select(
        "ord", "text_key", "line_no", "n", F.xxhash64("ranks").alias("k1"), F.xxhash64(F.lit(1), "ranks").alias("k2"),
        *[F.aggregate(quarter, F.lit(0).cast("long"), turned).alias(p) for p, quarter in zip(PARITY, quarters, strict=True)],
        F.transform(rarest, lambda x: (x % 2147483647).cast("int")).alias("prefix"),
    )


def _class(n: Column) -> Column:
    """The class of length of a set of n tokens."""
    return F.floor(F.log(n) / F.log(F.lit(STEP))).cast("int")


def _filed(sets: DataFrame, *more: Column, turn: int | None = None) -> DataFrame:
    """One row per set (``id``) and bucket: its prefix tokens in its own class of length, and in the next class as the smaller set.

    A set is in the next class only if a set of that class is short enough to be similar.
    ``rest`` tokens of the set follow from this one on, itself included.  As the smaller of
    two sets, a set shares one of its first n - need(n, n) + 1 tokens or is not similar.
    ``turn`` takes the tokens of one pass only.
    """
    length, longest = _class(F.col("n")), _class(F.expr("5 * n div 4"))  # of the set, and of the longest set that can be similar
    own = sets.filter(F.col("n") >= LEAST_SIZE).select("id", "n", *PARITY, "prefix", length.alias("length"), longest.alias("longest"), F.posexplode("prefix").alias("i", "token"))
    if turn is not None:
        own = own.filter(F.pmod("token", F.lit(PASSES)) == turn)
    smaller = (F.col("i") <= F.col("n") - F.expr("(8 * n + 8) div 9")) & (F.col("longest") > F.col("length"))
    classes = F.when(smaller, F.array("length", F.col("length") + 1)).otherwise(F.array("length"))
    filed = own.withColumn("length", F.explode(classes))
    return filed.select(F.hash("token", "length").alias("bucket"), "id", "n", (F.col("n") - F.col("i")).alias("rest"), *PARITY, *more)


def _need() -> Column:
    """Shared tokens that 0.8 asks for, of sets of n and n_e tokens."""
    return F.expr("(4 * (n_o + n_e) + 8) div 9")


def _apart() -> Column:
    """At least so many tokens are in one of two sets only."""
    low, high = (F.bit_count(F.col(f"{p}_o").bitwiseXOR(F.col(f"{p}_e"))) for p in PARITY)
    return low + high


def _fits() -> Column:
    """Whether lengths and parity of two rows of a bucket let their sets be similar."""
    lengths = (F.col("n_o") * 5 >= F.col("n_e") * 4) & (F.col("n_e") * 5 >= F.col("n_o") * 4)
    return (F.col("bucket_o") == F.col("bucket_e")) & lengths & (_apart() <= F.col("n_o") + F.col("n_e") - 2 * _need())


def _follows() -> Column:
    """Whether enough tokens follow the shared one in both sets."""
    return F.least("rest_o", "rest_e") >= _need()


@contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    before = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _any(rows: DataFrame, condition: Column, label: str, *columns: str) -> DataFrame:
    """``columns`` of the rows (own: names end in _o) for which another row (names end in _e) meets the condition, without repetition, as a written table.

    Both sides are the same rows under new names, and the join stays above them, so they are
    made and shuffled once.
    """
    spark, rules = rows.sparkSession, "spark.sql.optimizer.excludedRules"
    above = ",".join(filter(None, [spark.conf.get(rules, None), "org.apache.spark.sql.catalyst.optimizer.PushDownLeftSemiAntiJoin"]))
    own, other = (rows.select(*[F.col(c).alias(f"{c}_{side}") for c in rows.columns]) for side in "oe")
    with _set(spark, {rules: above}):
        return settle(own.join(other, condition, "left_semi").select(*[F.col(f"{c}_o").alias(c) for c in columns]).distinct(), label)


def _members(sets: DataFrame) -> DataFrame:
    """Ids of the sets for which some other set passes all filters.

    Tokens are dealt to ``PASSES`` passes by their hash and the shuffle files of a pass are
    given back before the next one, as the prefixes together are larger than the texts.
    Both sides of a join are the same rows, so they are shuffled once.
    """
    found = []
    for turn in range(PASSES):
        found.append(_any(_filed(sets, turn=turn), _fits() & (F.col("id_o") != F.col("id_e")) & _follows(), "similar-lines", "id"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    every = settle(every.distinct(), "similar-lines")
    release(*found)
    return every


def _among(key: Column, keys: DataFrame) -> Column:
    """Whether ``key`` may be the only column of ``keys``: a bitmap of fixed size (4 million bits) that never misses one."""
    slot, bit = F.col("key").bitwiseAND((1 << SLOT_BITS) - 1), F.expr(f"shiftleft(1L, cast(shiftright(key, {SLOT_BITS}) & 63 as int))")
    words = dict(keys.toDF("key").select(slot.alias("s"), bit.alias("b")).groupBy("s").agg(F.bit_or("b")).collect())
    table = F.split(F.lit(",".join(str(words.get(i, 0)) for i in range(1 << SLOT_BITS))), ",").cast("array<long>")
    word = F.get(table, key.bitwiseAND((1 << SLOT_BITS) - 1).cast("int"))
    return F.call_function("shiftrightunsigned", word, F.shiftright(key, SLOT_BITS).bitwiseAND(63).cast("int")).bitwiseAND(1) == 1


def _with_tokens(members: DataFrame, texts: DataFrame) -> DataFrame:
    """``members`` with their real token set (``set``: 64-bit hashes), read from their first line."""
    by_text = members.groupBy("first.ord", "first.text_key").agg(F.collect_list(F.struct("first.line_no", "id")).alias("places"))
    texts = texts.filter(_among(F.col("text_key"), members.select("first.text_key")))  # most others are not shuffled
    chosen = texts.join(by_text, ["ord", "text_key"]).select(F.split("text", "\n").alias("lines"), F.explode("places").alias("p"))
    lines = chosen.select("p.id", F.array_distinct(F.transform(tokens(F.get("lines", F.col("p.line_no"))), lambda w: F.xxhash64(w))).alias("set"))
    return members.join(lines.dropDuplicates(["id"]), "id")  # rows that repeat id and text give the same line


def _later(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """The keys (k1, k2) of the sets that have an earlier set within 0.8, each once."""
    found = _members(sets.withColumnRenamed("k1", "id"))
    few = sets.join(found.withColumnRenamed("id", "k1"), "k1", "left_semi")
    placed = settle(few.withColumn("id", F.monotonically_increasing_id()), "line-members")
    members = settle(_with_tokens(placed, texts), "line-members")
    # a pair is looked at under the first token that it shares
    rows = _filed(members, F.expr("slice(prefix, 1, i)").alias("before"))
    unshared = ~F.arrays_overlap("before_o", "before_e")
    met = _any(rows, _fits() & (F.col("id_o") != F.col("id_e")) & _follows() & unshared, "shared-tokens", "bucket", "id")
    whole = met.join(members.select("id", "first", "n", *PARITY, "set"), "id")
    alike = F.size(F.array_intersect("set_o", "set_e")) >= _need()
    held = _any(whole, _fits() & (F.col("first_e") < F.col("first_o")) & alike, "later-sets", "id")
    later = settle(members.select("id", "k1", "k2").join(held, "id", "left_semi").select("k1", "k2"), "later-sets")
    release(found, placed, members, met, held)
    return later


def repeated_lines(docs: DataFrame) -> DataFrame:
    """Lines to remove: doc_id, text_key, n_lines, n_removed, n_near, removed_lines (ascending, from 0).

    Lines are split at line feeds; tokens are runs without white space, unchanged, and a
    line is their set.  A line is removed if an earlier line, by (doc_id, place in the text),
    has a token set with a Jaccard similarity of at least 0.8, whether or not that line
    stays itself.  ``n_near`` counts lines that match an earlier line of another set.  Lines
    without tokens always stay.  Null texts are one empty line.  Rows without an id come
    last, ordered by their text; rows that repeat id and text are the same document.  An
    empty table gives no rows; other columns are ignored.
    """
    plain = documents(docs)
    texts = plain.select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("text_key"), "text")
    lines = settle(_lines(texts), "lines")
    first = F.min(F.struct("ord", "text_key", "line_no", "n", *PARITY, "prefix")).alias("m")
    sets = lines.groupBy("k1", "k2").agg(first, F.count(F.lit(1)).alias("lines"))
    sets = sets.select("k1", "k2", "lines", "m.n", *[f"m.{p}" for p in PARITY], "m.prefix", F.struct("m.ord", "m.text_key", "m.line_no").alias("first"))
    sets = settle(sets, "line-sets")
    later = _later(sets, texts)

    # no other set loses a line; of a set with an earlier one within 0.8, the first line goes as well
    copied = sets.filter("lines > 1").select("k1", "k2", "first").join(later, ["k1", "k2"], "left_anti")
    near = later.withColumns({"first": F.lit(None).cast(sets.schema["first"].dataType), "near": F.lit(True)})
    named = settle(copied.withColumn("near", F.lit(False)).unionByName(near), "named-sets")

    own = F.struct("ord", "text_key", "line_no")
    # one row per set against all lines: adaptive execution splits the very common lines
    judged = lines.select("ord", "text_key", "line_no", "k1", "k2").join(named, ["k1", "k2"])
    gone = judged.filter(F.col("near") | (own != F.col("first"))).select("ord", "text_key", "line_no", "near")
    gone = gone.groupBy("ord", "text_key").agg(
        F.sort_array(F.collect_set("line_no")).alias("removed_lines"), F.size(F.collect_set(F.when(F.col("near"), F.col("line_no")))).alias("n_near")
    )
    rows = plain.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("text_key"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))
    out = rows.join(gone, ["ord", "text_key"], "left")
    none = F.array().cast("array<int>")
    return out.select(
        "doc_id", "text_key", "n_lines", F.coalesce(F.size("removed_lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.coalesce("removed_lines", none).alias("removed_lines"),
    )


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, and ``n_chars`` counted anew if there is one.

    Every row stays, also one that has lost all its lines (its text is empty then); a null
    text stays null.  All columns keep their names and order.
    """
    found = repeated_lines(docs).filter("n_removed > 0").select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), "text_key", F.col("removed_lines").alias("gone"))
    joined = whole_rows(docs).join(found.dropDuplicates(["ord", "text_key"]), ["ord", "text_key"], "left")
    text, hit = F.col("row").getField("text"), F.col("gone").isNotNull()
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("gone", i)), "\n")
    changed = {"text": F.when(hit, kept).otherwise(text)}
    if "n_chars" in docs.columns:
        length = F.length(kept).cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.when(hit, length).otherwise(F.col("row").getField("n_chars"))
    return unpacked(joined, docs.columns, **changed)
