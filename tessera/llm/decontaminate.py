"""Benchmark decontamination over a distributed positional inverted index, in DataFrame functions only.

The index stores, for each term of the benchmark, the places where it stands in the training
texts. A window of benchmark words can only occur where its two rarest terms stand at the right
distance: their lists are intersected after subtracting the terms' offsets in the item, so that
agreeing entries name the same alignment of item and document. Only at the alignments that are
left are the other terms' lists intersected; a window occurs where every offset of it agrees.
Documents that hold an item's two rarest terms at about their distance are its proximity matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.scratch import cut, small_table

#: What separates words (ASCII but for digits and letters), and the letters lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tables of at most so many rows of a few numbers are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 300_000


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, other letters as they are."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def sized(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be broadcast if its counted rows are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class PositionalIndex:
    """Postings ``(row, doc, pos, term)`` of chosen terms, in a written table.

    ``row`` numbers the rows of the source, ``doc`` is its id. Term 0 marks the end of each text,
    so its posting holds the number of words.
    """

    def __init__(self, postings: DataFrame, terms: DataFrame):
        self.postings, self.terms = postings, terms

    @classmethod
    def build(cls, docs: DataFrame, vocabulary: DataFrame, id_col: str, text_col: str) -> PositionalIndex:
        """The index of the words in ``vocabulary(word)`` (distinct, not null)."""
        numbered = vocabulary.select("word", (F.monotonically_increasing_id() + 1).alias("term"))
        terms = cut(numbered, "terms")
        entries = terms.union(small_table(docs.sparkSession, [("", 0)], "word string, term bigint"))
        rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc"), words_of(F.col(text_col)).alias("words"))
        places = rows.select("row", "doc", F.posexplode(F.array_append("words", "")).alias("pos", "word"))
        return cls(cut(places.join(sized(entries, terms.count()), "word").select("row", "doc", "pos", "term"), "postings"), terms)

    def documents(self) -> DataFrame:
        """``(row, doc, n_words)`` of every row of the source."""
        return self.postings.where("term = 0").select("row", "doc", F.col("pos").cast("bigint").alias("n_words"))

    def frequencies(self) -> DataFrame:
        """``(term, df)``: in how many places each term that occurs stands."""
        return self.postings.where("term <> 0").groupBy("term").agg(F.count("*").alias("df"))


def item_windows(places: DataFrame, length: int) -> DataFrame:
    """``(item, start, size)``: every run of ``length`` words, or the whole of a shorter item."""
    sizes = places.groupBy("item").agg((F.max("ipos") + 1).alias("m"))
    size = F.least("m", F.lit(length))
    return sizes.select("item", size.alias("size"), F.explode(F.sequence(F.lit(0), F.col("m") - size)).alias("start"))


def _item_places(index: PositionalIndex, items: DataFrame, text_col: str) -> DataFrame:
    """``(item, ipos, term, df)``; a word that no document has is term null."""
    places = items.select("item", F.posexplode(words_of(F.col(text_col))).alias("ipos", "word"))
    return places.join(index.terms, "word", "left").join(index.frequencies(), "term", "left").select("item", "ipos", "term", "df")


def phrase_matches(index: PositionalIndex, places: DataFrame, length: int) -> DataFrame:
    """``(row, doc, item, shift, start, size)``: the words of ``item`` from ``start`` on, ``size`` of them, occur at ``shift + start``.

    ``size`` is at least ``length``, or the whole of a shorter item; each stretch is as long as it can be.
    """
    spans = item_windows(places, length)
    inside = spans.select("item", "start", "size", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("ipos")).join(places, ["item", "ipos"])
    whole = Window.partitionBy("item", "start")
    rare = inside.withColumn("df_min", F.min(F.coalesce("df", F.lit(0))).over(whole)).where("df_min > 0")
    ranked = rare.withColumn("rank", F.row_number().over(whole.orderBy("df", "ipos"))).where("rank <= 2")
    windows = cut(ranked.groupBy("item", "start", "size").agg(F.min("ipos").alias("first"), F.max("ipos").alias("second")), "windows")
    n = windows.count()

    # The rarest terms' lists, less their offsets; alignments at which both terms of a window stand.
    anchors = windows.select("item", F.explode(F.array("first", "second")).alias("ipos")).distinct().join(places, ["item", "ipos"]).select("item", "ipos", "term")
    hits = index.postings.join(sized(anchors, 2 * n), "term").select("row", "doc", "item", (F.col("pos") - F.col("ipos")).alias("shift"), "ipos")
    alignment = ["row", "doc", "item", "shift"]
    met = hits.groupBy(*alignment).agg(F.collect_set("ipos").alias("at"))
    pairs = windows.groupBy("item", "first", "second").agg(F.flatten(F.collect_list(F.expr("sequence(start, start + size - 1)"))).alias("spanned"))
    met = met.join(sized(pairs, n), "item").where("array_contains(at, first) and array_contains(at, second)")
    asked = met.groupBy(*alignment).agg(F.array_distinct(F.flatten(F.collect_list("spanned"))).alias("ipos"))
    aligned = cut(asked.select(*alignment, F.explode("ipos").alias("ipos")), "aligned")
    rows = aligned.select("row").distinct()

    # The other terms' lists, only where those alignments put them.
    expected = aligned.join(sized(places.select("item", "ipos", "term"), places.count()), ["item", "ipos"]).withColumn("pos", F.col("shift") + F.col("ipos"))
    near = index.postings.where("term <> 0").join(sized(rows, rows.count()), "row", "left_semi").select("row", "pos", "term")
    agree = expected.join(near, ["row", "pos", "term"]).groupBy(*alignment).agg(F.sort_array(F.collect_set("ipos")).alias("at"))
    # Consecutive words have the same difference of place and rank.
    ranks = agree.select(*alignment, F.posexplode("at").alias("rank", "ipos"))
    runs = ranks.groupBy(*alignment, (F.col("ipos") - F.col("rank")).alias("run")).agg(F.min("ipos").alias("start"), F.count("*").cast("int").alias("size"))
    least = spans.groupBy("item").agg(F.max("size").alias("least"))
    return runs.join(sized(least, n), "item").where("size >= least").select(*alignment, "start", "size")


def proximity_matches(index: PositionalIndex, places: DataFrame, within: int) -> DataFrame:
    """``(row, doc, item)``: documents in which the item's two rarest terms, in the item's order, stand at most ``within`` words further apart or closer than in the item."""
    rarest = places.where("df is not null").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy("df", "ipos"))).where("rank <= 2")
    rarest = rarest.select("item", "ipos", "term", "rank")
    shifts = index.postings.join(sized(rarest, rarest.count()), "term").select("row", "doc", "item", "rank", "ipos", "pos", (F.col("pos") - F.col("ipos")).alias("shift"))
    cell = F.floor(F.col("shift") / (within + 1))
    one = shifts.where("rank = 1").selectExpr("row", "doc", "item", "ipos i1", "pos p1", "shift s1").withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("s1") / (within + 1)) + d)))
    two = shifts.where("rank = 2").select("row", "item", F.col("ipos").alias("i2"), F.col("pos").alias("p2"), F.col("shift").alias("s2"), cell.alias("cell"))
    return one.join(two, ["row", "item", "cell"]).where(f"abs(s1 - s2) <= {int(within)} and sign(p2 - p1) = sign(i2 - i1)").select("row", "doc", "item").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", length: int = 10, within: int | None = None) -> DataFrame:
    """``(id, n_words, n_hit, n_items, items, contaminated)``, one row per row of ``docs``; with ``within`` also ``n_near``.

    Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is
    ``length`` consecutive words of an item, or all of a shorter one. ``n_hit`` counts the
    document's words inside any occurrence of a window, ``items`` lists the ids of the items with
    such windows, sorted as strings and joined by commas. ``n_near`` is the number of items near by:
    see :func:`proximity_matches`; items of fewer than two words that occur anywhere have none.

    Null and empty texts have no words: such documents are clean, such items occur nowhere. Rows
    that repeat a document's id are searched on their own; texts that repeat an item's id count
    as one item; items of a null id count for ``n_hit`` but are not listed. Null document ids
    are carried. Other columns are not read.
    """
    items = cut(benchmark.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).cast("string").alias("name"), F.col(item_text_col).alias("words_text")), "items")
    vocabulary = items.select(F.explode(words_of(F.col("words_text"))).alias("word")).distinct()
    index = PositionalIndex.build(docs, vocabulary, id_col, text_col)
    places = cut(_item_places(index, items, "words_text"), "places")
    matches = cut(phrase_matches(index, places, length), "matches")
    covered = matches.select("row", F.explode(F.expr("sequence(shift + start, shift + start + size - 1)")).alias("pos")).distinct()
    hit = covered.groupBy("row").agg(F.count("*").alias("n_hit"))
    names = items.select("item", "name")
    named = matches.select("row", "item").distinct().join(names, "item").groupBy("row").agg(F.array_sort(F.collect_set("name")).alias("names"))
    found = hit.join(named, "row", "left")
    if within is not None:
        near = proximity_matches(index, places, within).join(names, "item").groupBy("row").agg(F.count_distinct("name").alias("n_near"))
        found = found.join(near, "row", "full")
    out = index.documents().join(found, "row", "left")
    more = () if within is None else (F.coalesce("n_near", F.lit(0)).alias("n_near"),)
    return out.select(
        F.col("doc").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce(F.size("names"), F.lit(0)).cast("bigint").alias("n_items"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        *more,
    )
