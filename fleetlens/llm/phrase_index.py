"""Benchmark decontamination by a distributed positional inverted index.

The index holds one posting per training word that some test item uses: the
row it stands in, its term and its place. (A term of no test item is in no
list that is ever read.) It is written where the text is read, without a
shuffle, so each file is a segment with the whole lists of its rows.

A phrase is searched from its rarest term: every posting of that term,
adjusted by the term's offset, is a possible start. The starts are intersected
with the list of the second rarest term, and only what is left meets the lists
of the other terms, which are read for the rows still in question. Every term
takes part, so a match is exact and needs no second look at the text. With
``slop`` a term may stand up to that many places off, which gives proximity
matches by the same intersection.

Everything is DataFrame work. The phrase tables are broadcast up to
HELD_ROWS rows; beyond that the joins shuffle, and adaptive execution splits
hot terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.scratch import stored

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a text: digits, lower-case letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of the terms and phrases of the test items that are still broadcast.
HELD_ROWS = 500_000
#: Numbers that rows hash to, to pick the lists of rows still in question.
SLOTS = 1 << 20


def words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; none for null."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, UPPER.lower())
    return F.regexp_extract_all(low, F.lit(WORD), F.lit(0))


def _held(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= HELD_ROWS else df


def phrases(items: DataFrame, *, window: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, phrase): every run of ``window`` consecutive words of an item.

    An item with fewer words, but not none, is one phrase; one without words
    (null, empty) has none. Rows that share an id are one item.
    """
    split = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("_words")).where(F.size("_words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("_words") - (window - 1), F.lit(1)))
    runs = F.transform(starts, lambda s: F.slice("_words", s, window))
    return split.select("item_id", F.explode(runs).alias("phrase")).distinct()


class PhraseIndex:
    """The postings of ``docs`` for the terms of ``wanted`` (item_id, phrase).

    ``columns`` are those of ``docs`` that results carry in the struct ``row``
    (default all). Null and empty texts have no words and match nothing;
    repeated rows are rows of their own; texts of any length are indexed whole.
    """

    def __init__(self, docs: DataFrame, wanted: DataFrame, *, text_col: str = "text", columns: list[str] | None = None):
        numbered = wanted.select("phrase").distinct().select(F.monotonically_increasing_id().alias("phrase_id"), "phrase")
        #: (phrase_id, phrase)
        self.phrases = stored(numbered, "phrases")
        spread = self.phrases.select("phrase_id", F.size("phrase").alias("length"), F.posexplode("phrase").alias("offset", "word"))
        terms = stored(spread.select("word").distinct().select("word", F.monotonically_increasing_id().alias("term")), "terms")
        self.n_terms = terms.count()
        self.postings = self._postings(docs, terms, text_col, columns or docs.columns)
        self.items = wanted.join(self.phrases, "phrase").select("phrase_id", "item_id")
        self.ranked = stored(self._ranked(spread.join(terms, "word")), "ranked")
        self.n_ranked = self.ranked.count()

    def _postings(self, docs: DataFrame, terms: DataFrame, text_col: str, columns: list[str]) -> DataFrame:
        row = F.struct(*[docs[c] for c in columns])
        texts = docs.select(F.monotonically_increasing_id().alias("tag"), row.alias("row"), words(docs[text_col]).alias("words"))
        placed = texts.select("tag", "row", F.size("words").alias("n_words"), F.posexplode_outer("words").alias("place", "word"))
        met = placed.join(_held(terms, self.n_terms), "word", "left")
        first = F.coalesce(F.col("place"), F.lit(0)) == 0
        kept = met.where(F.col("term").isNotNull() | first)
        # Stored, so that the tags given to rows are fixed. The row itself goes with its first word only.
        return stored(kept.select("tag", "term", "place", "n_words", first.alias("head"), F.when(first, F.col("row")).alias("row")), "postings")

    def _ranked(self, spread: DataFrame) -> DataFrame:
        """The terms of each phrase from the rarest on; phrases with a term of no posting are left out."""
        counts = self.lists().groupBy(F.col("term").alias("_term")).agg(F.count(F.lit(1)).alias("n"))
        known = spread.join(counts, F.col("term") == F.col("_term"), "left")
        phrase = Window.partitionBy("phrase_id")
        known = known.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("least", F.min("n").over(phrase))
        rank = F.row_number().over(phrase.orderBy("n", "term", "offset"))
        return known.withColumn("rank", rank).where("least > 0").select("phrase_id", "length", "offset", "term", "rank")

    def rows(self) -> DataFrame:
        """(tag, row, n_words) of every row of the table, those without words too."""
        return self.postings.where("head").select("tag", "row", "n_words")

    def lists(self) -> DataFrame:
        return self.postings.where("term is not null").select("tag", "term", "place")

    def matches(self, slop: int = 0) -> DataFrame:
        """(tag, phrase_id, start, length): where a phrase stands.

        ``start`` is the place (from 0) of the phrase's first word as told by
        its rarest term. With ``slop`` every other term may stand up to that
        many places before or after its own; 0 gives exact matches only.
        """
        rarest = self._at_rank(F.col("rank") == 1).select("phrase_id", "length", "offset", "term")
        starts = self.lists().join(rarest, "term").select("tag", "phrase_id", "length", (F.col("place") - F.col("offset")).alias("start"))
        second = self._at_rank(F.col("rank") == 2)
        terms = second.select("term").distinct()
        left = self._met(starts.where("length > 1"), second, self.lists().join(_held(terms, self.n_ranked), "term", "left_semi"), slop)
        left = stored(left.unionByName(starts.where("length = 1")), "starts")
        slot = F.pmod(F.xxhash64("tag"), F.lit(SLOTS)).alias("_slot")
        longer = left.where("length > 2")
        slots = longer.select(slot).distinct()
        asked = self.lists().withColumn("_slot", slot).join(F.broadcast(slots), "_slot", "left_semi")
        whole = self._met(longer, self._at_rank(F.col("rank") > 2), asked.drop("_slot"), slop)
        return stored(whole.unionByName(left.where("length <= 2")), "matches")

    def _at_rank(self, condition: Column) -> DataFrame:
        return _held(self.ranked.where(condition), self.n_ranked)

    def _met(self, starts: DataFrame, terms: DataFrame, lists: DataFrame, slop: int) -> DataFrame:
        """The starts at which all of ``terms`` of the phrase stand where they should."""
        wanted = starts.join(terms.select("phrase_id", "offset", "term"), "phrase_id")
        off = F.explode(F.sequence(F.lit(-slop), F.lit(slop))) if slop else F.lit(0)
        wanted = wanted.select("*", off.alias("_off"))
        wanted = wanted.withColumn("place", F.col("start") + F.col("offset") + F.col("_off")).drop("_off")
        needed = terms.groupBy("phrase_id").agg(F.count(F.lit(1)).alias("_needed"))
        found = wanted.join(lists, ["tag", "term", "place"])
        if slop:
            found = found.select("tag", "phrase_id", "start", "length", "offset").distinct()
        found = found.groupBy("tag", "phrase_id", "start", "length").agg(F.count(F.lit(1)).alias("_found"))
        return found.join(_held(needed, self.n_ranked), "phrase_id").where("_found = _needed").select("tag", "phrase_id", "start", "length")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    *,
    window: int = 10,
    id_col: str = "item_id",
    text_col: str = "text",
    item_text_col: str = "text",
    columns: list[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` with the test items it repeats.

    Returns ``row`` (a struct of ``columns``, default all of ``docs``), n_words,
    n_hit (words inside a match of a phrase of ``window`` words, or of a whole
    shorter item), n_items, items (their ids as strings, sorted; a null id is
    the empty string) and contaminated. Rows with null or empty texts have no
    words and no hits; an empty table of documents gives no rows, and without
    items nothing is hit.
    """
    index = PhraseIndex(docs, phrases(items, window=window, id_col=id_col, text_col=item_text_col), text_col=text_col, columns=columns)
    matches = index.matches()
    found = matches.select("tag", "phrase_id").distinct().join(index.items, "phrase_id")
    name = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    found = found.groupBy("tag").agg(F.array_sort(F.collect_set(name)).alias("items"))
    told = index.rows().join(covered(matches), "tag", "left").join(found, "tag", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    none = F.array().cast("array<string>")
    return told.select(
        "row",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", none).alias("items"),
        (n_hit > 0).alias("contaminated"),
    )


def covered(matches: DataFrame) -> DataFrame:
    """(tag, n_hit): words of a row that stand inside any match."""
    ends = matches.groupBy("tag", "start").agg((F.col("start") + F.max("length")).alias("end"))
    before = Window.partitionBy("tag").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("end") - F.greatest(F.col("start"), F.max("end").over(before))
    counted = ends.select("tag", F.greatest(new, F.lit(0)).cast("long").alias("new"))
    return counted.groupBy("tag").agg(F.sum("new").alias("n_hit"))
