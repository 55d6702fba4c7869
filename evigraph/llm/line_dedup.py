"""Removal of lines that repeat earlier ones: an exact set-similarity join in DataFrame operations alone.

A line is the set of its words.  Texts are split once: each line is written with a 32-bit hash of each of its words, and all
steps but the last check read these.  Words are ordered by rarity (how often the hash bucket of a word occurs in
the whole corpus, then by hash).  Two lines of Jaccard similarity T or more share a word of their prefixes in that
order, where the line that isn't larger needs only about half of its prefix (its index).  Lines are therefore joined on words
of index and prefix under a length filter, a positional filter, and a bound on the overlap from bitmaps of the
sets.  Bitmaps of long lines are full and tell little, so these have prefixes longer by a word and must meet on two.  Pairs that
met are compared by the hashes of all words, and each line that goes is verified on the
words themselves with one earlier line.  A line goes if any earlier one is similar enough.

Equal lines are one from the start.  Words that many prefixes share are joined within bands of line sizes:
first every line meets a few early lines of its bands, and only lines that these don't already remove meet all
others.  What is said of a word to the join is 31 bits of its place in the order, so two words may meet as one;
that can only add pairs to verify.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evigraph.llm.workspace import ROW_KEY, Workspace, filed, located

#: Similarity from which on the later line goes, as a fraction.
PART, WHOLE = 4, 5
#: Hash buckets in which words are counted, as bits; places of the sieves that let most unwanted rows go before a shuffle, as bits.
RARITY_BITS, SIEVE_BITS = 18, 22
#: Prefix words that similar lines have in common at least if both have LONG words or more; else it is one.
SHARED, LONG = 2, 64
#: A word in the prefixes of more lines than this first meets so many early lines of each band of sizes.
HOT, PIVOTS = 512, 8
#: Parts in which words that aren't hot are joined.
PARTS = 2
#: Bands of line sizes in a doubling: sizes of similar lines differ by a factor of 1.25 at most, so by one band.
BANDS = 3
BLANKS = "\t\x0b\f\r"
#: Options for tables of hashes, for which dictionaries of values are made in vain.
HASHES = {"parquet.enable.dictionary": "false"}
#: Spark's setting for arrays without nulls written as plain repeated values, in place of a group for each.
PLAIN_LISTS = "spark.sql.parquet.writeLegacyFormat"
#: Spark's setting for the places, as bits, of the compiled table that an aggregation fills before a slower one.
MAP_BITS = "spark.sql.codegen.aggregate.fastHashMap.capacityBit"


def _blank(text: Column) -> Column:
    """Whether a text has blanks other than spaces and line ends: splitting at one character looks for it many times faster than a regex."""
    return reduce(Column.__or__, (F.size(F.split(text, blank)) > 1 for blank in BLANKS))


def _split(line: Column, blank: Column | None = None) -> Column:
    """The words of a line in lower case, split at ASCII white space, with empty ones between blanks.

    ``blank`` is false only where the line has none but spaces; other lines are looked through.
    """
    some = line.rlike(f"[{BLANKS}]")
    some = some if blank is None else blank & some
    even = F.when(some, F.translate(line, BLANKS, " " * len(BLANKS))).otherwise(line)
    return F.split(F.lower(even), " ")


def words_of(line: Column, blank: Column | None = None) -> Column:
    """The distinct words of a line; ``blank`` as for ``_split``."""
    return F.array_except(_split(line, blank), F.array(F.lit("")))


def _word_hash(word: Column) -> Column:
    return F.hash(word)


@contextmanager
def _set(session: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session with a setting that ends with the block."""
    before = session.conf.get(key, None)
    session.conf.set(key, value)
    try:
        yield
    finally:
        session.conf.set(key, before) if before is not None else session.conf.unset(key)


def _table(cells: DataFrame, size: int, space: Workspace, name: str, kind: str = "bigint") -> DataFrame:
    """``cells`` (at, value) as one row with an array of ``size`` numbers, a fixed bound; places without a cell are 0.

    Used as a scalar subquery, the array is read from its place in memory; as a literal its numbers would be objects
    and stand in every plan's text, and joined in it would be copied for every row.
    """
    every = cells.sparkSession.range(size).withColumnRenamed("id", "at").join(cells.select(F.col("at").cast("bigint").alias("at"), "value"), "at", "left")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("value", F.lit(0)).cast(kind).alias("value")))), lambda c: c["value"])
    return space.put(every.agg(listed.alias("cells")).coalesce(1), name)


def _sieve(rows: DataFrame, number: str, space: Workspace, name: str) -> DataFrame:
    """The low SIEVE_BITS bits of the column ``number`` of all rows as a bitmap, 64 places to a number."""
    place = F.col(number).cast("bigint").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    marks = rows.select(F.shiftright(place, 6).alias("at"), F.expr(f"shiftleft(1L, cast({number} & 63 AS int))").alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("value"))
    return _table(marks, 1 << (SIEVE_BITS - 6), space, name)


def _passes(sieve: DataFrame, number: str) -> Column:
    """Whether a number may be one of the sieve's; true for all of them and for some others."""
    place = F.col(number).cast("bigint").bitwiseAND(F.lit((1 << SIEVE_BITS) - 1))
    return F.getbit(F.get(sieve.scalar(), F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1


def _lines(docs: DataFrame, text_col: str, *more: str | Column) -> DataFrame:
    """The lines of all texts: line, pos from 0, and ``more`` of the document's columns.

    No text is without lines; without ``outer`` Spark would first split each one to see that.
    """
    return docs.select(*more, F.posexplode_outer(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))


def _prints() -> list[Column]:
    """Two hashes that tell lines apart, 128 bits in all."""
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(11), "line").alias("h2")]


def _coded(docs: DataFrame) -> DataFrame:
    """Every line: doc_id, ROW_KEY, pos, n_lines (of the text), h1, h2, full (whether it has words), words (their hashes, one for each)."""
    text = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", *ROW_KEY, F.split(text, "\n").alias("all"), _blank(text).alias("blank"))
    lines = texts.select("doc_id", *ROW_KEY, F.size("all").cast("bigint").alias("n_lines"), "blank", "all").select("doc_id", *ROW_KEY, "n_lines", "blank", F.posexplode_outer("all").alias("pos", "line"))
    # A condition on the words would be evaluated with all of them once more.
    full = F.col("line").rlike(f"[^ \n{BLANKS}]").alias("full")
    return lines.select("doc_id", *ROW_KEY, "pos", "n_lines", *_prints(), full, F.transform(words_of(F.col("line"), F.col("blank")), _word_hash).alias("words"))


def _rarity(docs: DataFrame, text_col: str, space: Workspace) -> DataFrame:
    """(bucket, n): how often words of every hash bucket occur, for a fixed number of buckets; of texts, or of coded lines."""
    if "words" in docs.columns:
        words = docs.select(F.explode("words").alias("h"))
    else:
        text = _split(F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit("\n"), F.lit(" ")))
        words = docs.select(F.explode_outer(text).alias("w")).where("w <> ''").select(_word_hash(F.col("w")).alias("h"))
    bucket = F.col("h").bitwiseAND(F.lit((1 << RARITY_BITS) - 1)).alias("bucket")
    with _set(docs.sparkSession, MAP_BITS, str(max(10, RARITY_BITS))):
        return space.put(words.groupBy(bucket).agg(F.count("*").alias("n")), "rarity")


def _unique(docs: DataFrame, counts: DataFrame, space: Workspace) -> DataFrame:
    """Each different line that has words: uid, h1, h2, n (occurrences), at (the first), size, prefix and bits; of texts, or of coded lines."""
    size = 1 << RARITY_BITS
    every = docs.sparkSession.range(size).withColumnRenamed("id", "bucket").join(counts, "bucket", "left")
    rank = F.row_number().over(Window.orderBy(F.coalesce("n", F.lit(0)), "bucket")) - 1  # of a fixed number of buckets
    ranks = _table(every.select(F.col("bucket").alias("at"), F.shiftleft(rank, 31 - RARITY_BITS).alias("value")), size, space, "ranks", "int")
    # The rank of the bucket in place of the bucket keeps all but one of the bits of the hash.  Keys that can't be null are
    # sorted as plain numbers.
    key = lambda h: F.coalesce(F.get("ranks", h.bitwiseAND(F.lit(size - 1))).bitwiseOR(F.shiftrightunsigned(h, RARITY_BITS + 1)), F.lit(0))
    lines = (docs if "words" in docs.columns else _coded(docs)).where("full").withColumn("ranks", ranks.scalar())
    keyed = lines.select("doc_id", *ROW_KEY, "pos", "h1", "h2", F.sort_array(F.transform("words", key)).alias("keys"))
    size = F.size("keys")
    # The longest prefix that may hold the first common word is size - ceil(size * T) + 1.
    prefix = F.slice("keys", 1, size - F.ceil(size * PART / WHOLE).cast("int") + _shared(size))
    # Lines of so few words are similar only if they are equal.
    bits = F.when(size < WHOLE - 1, F.xxhash64("keys")).otherwise(F.expr("aggregate(keys, 0L, (acc, k) -> acc ^ shiftleft(1L, k))"))
    at = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", *ROW_KEY, "pos").alias("at")
    rows = keyed.select("h1", "h2", at, size.alias("size"), prefix.alias("prefix"), bits.alias("bits"))
    groups = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("at").alias("at"), F.first("size").alias("size"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    with _set(docs.sparkSession, PLAIN_LISTS, "true"):
        return space.put(groups.withColumn("uid", F.monotonically_increasing_id()), "unique", **HASHES)


def _shared(size: Column) -> Column:
    """Prefix words on which a line has to meet others of its size."""
    return F.when(size < LONG, 1).otherwise(SHARED)


def _size(side: str) -> Column:
    return F.shiftright(F.col(f"{side}.spot"), 32)


def _place(side: str) -> Column:
    return F.col(f"{side}.spot").bitwiseAND(F.lit((1 << 32) - 1))


def _met(a: DataFrame, b: DataFrame, on: list[str], order: Column) -> DataFrame:
    """Pairs (a, b with a < b) of uids that meet on a prefix word and pass all filters, with what the meeting counts for."""
    a, b = a.alias("a"), b.alias("b").hint("merge")
    total = _size("a") + _size("b")
    cond = order
    for name in on:
        cond = (F.col(f"a.{name}") == F.col(f"b.{name}")) & cond
    cond &= (_size("b") * PART <= _size("a") * WHOLE) & (_size("a") * PART <= _size("b") * WHOLE)
    shared = _shared(F.least(_size("a"), _size("b")))
    # Before one of the first ``shared`` common words there are fewer than ``shared`` others.
    cond &= (shared + F.least(_size("a") - _place("a"), _size("b") - _place("b"))) * (PART + WHOLE) >= total * PART
    # Twice the overlap is the sum of the sizes without the words that only one line has, which differing bits count from below.
    cond &= (total - F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits")))) * (PART + WHOLE) >= total * 2 * PART
    return a.join(b, cond).select(F.least("a.uid", "b.uid").alias("a"), F.greatest("a.uid", "b.uid").alias("b"), F.when(shared < SHARED, SHARED).otherwise(1).alias("weight"))


def _met_small(posted: DataFrame) -> DataFrame:
    """The pairs of ``_met`` where the one that isn't larger has the word in its index.

    As overlaps grow with the larger line, a smaller one's common words begin within size - ceil(2 * size * T / (1 + T)) + 1.
    """
    dealt = posted.repartition("word")
    index = (_place("a") - _shared(_size("a"))) * (PART + WHOLE) <= _size("a") * (WHOLE - PART)
    # Rows are dealt once for both sides, so this must not be applied before; a condition that may depend on the partition stays.
    index = F.when(F.spark_partition_id() >= 0, index).otherwise(False)
    smaller = (_size("a") < _size("b")) | ((_size("a") == _size("b")) & (F.col("a.uid") < F.col("b.uid")))
    return _met(dealt.alias("a").where(index), dealt, ["word"], smaller)


def _wanted(pairs: DataFrame, ends: tuple[str, str], known: DataFrame, space: Workspace, name: str) -> DataFrame:
    """The rows of ``known`` (uid, ...) that are an end of some pair."""
    asked = pairs.select(F.explode(F.array(*ends)).alias("uid"))
    sieve = _sieve(asked.select(F.xxhash64("uid").alias("mark")), "mark", space, f"{name}-marks")
    maybe = known.withColumn("mark", F.xxhash64("uid")).where(_passes(sieve, "mark")).drop("mark")
    return space.put(asked.distinct().join(maybe.hint("merge"), "uid"), name)


def _alike(pairs: DataFrame, unique: DataFrame, coded: DataFrame, space: Workspace, name: str) -> DataFrame:
    """(later, earlier) of the ``pairs`` whose words may reach the similarity by their hashes."""
    pairs = space.put(pairs, f"{name}-pairs")
    known = unique.select("uid", "h1", "h2", "at")
    wanted = _wanted(pairs, ("a", "b"), known, space, f"{name}-wanted")
    kept = coded.select("h1", "h2", "words").where(_passes(_sieve(wanted, "h1", space, f"{name}-sieve"), "h1"))
    one = kept.groupBy("h1", "h2").agg(F.first("words").alias("all"))
    # Short hashes of words, of which a set may have fewer than words: their overlap is taken as at least that of the words.
    sets = wanted.join(one.hint("merge"), ["h1", "h2"]).select("uid", "at", F.size("all").alias("size"), F.array_distinct("all").alias("words"))
    sets = space.put(sets, f"{name}-sets", **HASHES)
    both = pairs.join(sets.toDF("a", "at_a", "n", "x").hint("merge"), "a").join(sets.toDF("b", "at_b", "m", "y").hint("merge"), "b")
    lost = F.col("n") + F.col("m") - F.size("x") - F.size("y")
    fits = (F.size(F.array_intersect("x", "y")) + lost) * (PART + WHOLE) >= (F.col("n") + F.col("m")) * PART
    is_later = F.col("at_a") > F.col("at_b")
    later = F.when(is_later, F.col("a")).otherwise(F.col("b")).alias("later")
    left = space.put(both.where(fits).select(later, F.when(is_later, F.col("b")).otherwise(F.col("a")).alias("earlier")), f"{name}-left")
    for part in ("pairs", "wanted", "sets"):
        space.drop(f"{name}-{part}")
    return left


def _confirmed(left: DataFrame, unique: DataFrame, docs: DataFrame, space: Workspace, name: str) -> DataFrame:
    """The lines (uid) of the pairs ``left`` (later, earlier) whose words reach the similarity with an earlier one's."""
    # Lines are read where they occur first, so texts without any of these aren't split.
    known = unique.select("uid", "h1", "h2", F.xxhash64(*(f"at.{key}" for key in ROW_KEY)).alias("home"))
    gone, turn = None, 0
    while True:  # one earlier line each in turn; a second turn is only for lines whose hashes were alike by chance
        asked = space.put(left.groupBy("later").agg(F.min("earlier").alias("earlier")), f"{name}-asked{turn}")
        wanted = _wanted(asked, ("later", "earlier"), known, space, f"{name}-wanted{turn}")
        homes = docs.withColumn("home", F.xxhash64(*ROW_KEY)).where(_passes(_sieve(wanted, "home", space, f"{name}-homes{turn}"), "home"))
        kept = _lines(homes, "text").select("line", *_prints()).where(_passes(_sieve(wanted, "h1", space, f"{name}-sieve{turn}"), "h1"))
        lines = wanted.join(kept.groupBy("h1", "h2").agg(F.first("line").alias("line")).hint("merge"), ["h1", "h2"]).select("uid", "line")
        shown = asked.join(lines.toDF("later", "x").hint("merge"), "later").join(lines.toDF("earlier", "y").hint("merge"), "earlier").select("later", "earlier", words_of(F.col("x"), _blank(F.col("x"))).alias("x"), words_of(F.col("y"), _blank(F.col("y"))).alias("y"))
        alike = F.size(F.array_intersect("x", "y")) * (PART + WHOLE) >= (F.size("x") + F.size("y")) * PART
        told = space.put(shown.select("later", "earlier", alike.alias("alike")), f"{name}-told{turn}")
        found = told.where("alike").select(F.col("later").alias("uid"))
        gone = found if gone is None else gone.union(found)
        failed = told.where("NOT alike")
        if failed.isEmpty():
            return gone
        turn += 1
        left = space.put(left.join(failed.select("later", F.col("earlier").alias("tried")).hint("merge"), "later").where("earlier <> tried").select("later", "earlier"), f"{name}-left{turn}")


def _removed(docs: DataFrame, coded: DataFrame, unique: DataFrame, counts: DataFrame, space: Workspace) -> DataFrame:
    """The different lines (uid) that an earlier one removes."""
    # A word in many prefixes is in a bucket of many words, and words are ordered by the number of their bucket.
    rare = (1 << RARITY_BITS) - counts.where(F.col("n") > HOT).count()
    often = space.put(unique.select(F.explode("prefix").alias("word")).where(F.col("word") >= F.lit(min(rare << (31 - RARITY_BITS), 2**31 - 1))).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") > HOT), "often")
    any_hot = not often.isEmpty()
    sieve = _sieve(often, "word", space, "often-sieve") if any_hot else None
    spot = F.shiftleft(F.col("size").cast("bigint"), 32).bitwiseOR(F.col("place0") + 1)
    posted = unique.select("uid", "at", "size", "bits", F.posexplode("prefix").alias("place0", "word")).withColumn("spot", spot)
    is_hot = _passes(sieve, "word") if any_hot else F.lit(False)
    # The join compares these for very many pairs, faster where they can't be null.
    small = posted.where(~is_hot).select(*(F.coalesce(name, F.lit(0)).alias(name) for name in ("word", "uid", "spot", "bits")))
    # Prefix words are joined part by part, so that only one part's are on disk at a time.
    share = lambda k: small.where(F.pmod("word", F.lit(PARTS)) == k)
    meetings = [space.put(_met_small(share(k)), f"met{k}", **HASHES) for k in range(PARTS)]
    met = reduce(DataFrame.union, meetings)
    enough = lambda rows: rows.groupBy("a", "b").agg(F.sum("weight").alias("n")).where(F.col("n") >= SHARED).select("a", "b")
    if not any_hot:
        return _confirmed(_alike(enough(met), unique, coded, space, "all"), unique, docs, space, "all")
    band = F.floor(F.log2("size") * BANDS).cast("int")
    hot = space.put(posted.where(is_hot).select("word", "uid", "at", "spot", "bits", band.alias("band")), "hot", compression="zstd")
    near = lambda rows: rows.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    # The earliest line in each of some parts of a word's lines of a band.
    part = F.pmod(F.xxhash64("uid"), F.lit(PIVOTS))
    pivots = space.put(hot.groupBy("word", "band", part.alias("part")).agg(F.min(F.struct("at", "uid", "spot", "bits")).alias("p")).select("word", "band", "p.*"), "pivots")
    earlier = F.col("b.at") < F.col("a.at")
    first = _alike(_met(hot, near(pivots), ["word", "band"], earlier).select("a", "b").distinct(), unique, coded, space, "first")
    early = first.select(F.col("later").alias("uid")).distinct()

    def rest(lines: DataFrame) -> DataFrame:
        return _met(near(lines), hot, ["word", "band"], earlier)

    others = _alike(enough(met.union(rest(hot.join(early.hint("merge"), "uid", "left_anti")))), unique, coded, space, "all")
    gone = _confirmed(first.union(others), unique, docs, space, "all")
    # Lines that early ones seemed to remove by their hashes alone meet all others after all.
    unsure = space.put(early.join(gone.hint("merge"), "uid", "left_anti"), "unsure")
    if unsure.isEmpty():
        return gone
    theirs = [met.join(unsure.withColumnRenamed("uid", side).hint("merge"), side, "left_semi").select("a", "b", "weight") for side in "ab"]
    theirs[1] = theirs[1].join(unsure.withColumnRenamed("uid", "a").hint("merge"), "a", "left_anti").select("a", "b", "weight")
    again = enough(reduce(DataFrame.union, theirs).union(rest(hot.join(unsure.hint("merge"), "uid", "left_semi"))))
    return gone.union(_confirmed(_alike(again, unique, coded, space, "again"), unique, docs, space, "again")).distinct()


def line_marks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_removed, removed (line numbers from 0, ascending).

    Lines come in the order of ids, rows of equal or null ids in that of the table's files and the rows in these,
    and within a text in that of their places; a null id comes last.  A line without words is never
    removed.  A null text has one empty line.  An empty table gives an empty result; other columns are
    ignored, whatever their names.  With ``carry`` the result has the columns that tell rows apart, too.
    """
    space = Workspace(docs.sparkSession, "lines", tidy=True)
    docs = located(filed(docs, space), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    with _set(docs.sparkSession, PLAIN_LISTS, "true"):
        coded = space.put(_coded(docs), "coded", **HASHES)
    counts = _rarity(coded, "text", space)
    unique = _unique(coded, counts, space)
    gone = _removed(docs, coded, unique, counts, space).withColumn("gone", F.lit(True))
    marks = gone.select(F.xxhash64("uid").alias("mark"))
    maybe = unique.withColumn("mark", F.xxhash64("uid")).where((F.col("n") > 1) | _passes(_sieve(marks, "mark", space, "gone-sieve"), "mark"))
    told = maybe.select("uid", "n", "h1", "h2", "at").join(gone.hint("merge"), "uid", "left").select("n", "h1", "h2", "at", F.coalesce("gone", F.lit(False)).alias("gone"))
    told = space.put(told.where("gone OR n > 1").drop("n"), "told", compression="zstd")
    places = coded.select(*ROW_KEY, "pos", "h1", "h2").where(_passes(_sieve(told, "h1", space, "told-sieve"), "h1"))
    own = F.col("pos") == F.col("at.pos")
    for name in ROW_KEY:
        own &= F.col(name) == F.col(f"at.{name}")
    marked = places.join(told.hint("merge"), ["h1", "h2"]).where(F.col("gone") | ~own).select(*ROW_KEY, "pos")
    found = marked.groupBy(*ROW_KEY).agg(F.sort_array(F.collect_list("pos")).alias("removed"))
    result = coded.where("pos = 0").select("doc_id", *ROW_KEY, "n_lines").join(found.hint("merge"), list(ROW_KEY), "left")
    result = result.withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return result.select("doc_id", "n_lines", F.size("removed").cast("bigint").alias("n_removed"), "removed", *(ROW_KEY if carry else ()))


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that ``line_marks`` removes cut out of their texts.

    Rows are matched by their place in the table's files, so null and repeated ids lose no row; a null text
    stays null, and a text that loses all its lines is empty.  All columns stay, in their order.
    """
    docs = filed(docs, Workspace(docs.sparkSession, "cut"))
    own = {name: f"_c{i}" for i, name in enumerate(docs.columns)}
    rows = located(docs, *(F.col(f"`{name}`").alias(short) for name, short in own.items()))
    marks = line_marks(docs, id_col, text_col, carry=True).select(*ROW_KEY, "removed")
    text = F.col(own[text_col])
    kept = F.filter(F.transform(F.split(text, "\n"), lambda line, i: F.when(~F.array_contains("removed", i), line)), lambda line: line.isNotNull())
    joined = rows.join(marks.hint("merge"), list(ROW_KEY), "left").withColumn(own[text_col], F.array_join(kept, "\n"))
    return joined.select(*(F.col(short).alias(name) for name, short in own.items()))
