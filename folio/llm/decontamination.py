"""Benchmark decontamination through a distributed positional inverted index. Native: SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.functions.text import NOT_WORD, lower_ascii, split_words
from folio.plans.lineage import store
from folio.plans.sizes import small

WINDOW = 13
LISTS = 2
"""Posting lists that are intersected first for a window: those of its rarest terms."""
NEAR_TERMS = 3
"""Terms of an item, its rarest, that make up its proximity query."""
MOST_TERMS = 1_000_000
"""Up to so many distinct terms of all items, one word a row, are broadcast; beyond, words are shuffled by term."""
END = ""
"""No word; its posting stands behind a text's last word, so a text's length is in the index too."""


def word_list(text: Column) -> Column:
    """A-Z lower-cased, then runs of digits, letters and everything beyond ASCII; null has none."""
    return split_words(lower_ascii(text), NOT_WORD)


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(item, off, term, size)``: every word of every item with its place from 0 and the item's number of words.

    Items that repeat id and text count once; an id with several texts is several items of that id. Null ids and items without words give nothing.
    """
    words = items.select(F.col(item_col).alias("item"), word_list(F.col(text_col)).alias("all")).where("size(all) > 0 and item is not null").distinct()
    key = F.struct("item", F.xxhash64("all").alias("body")).alias("item")
    return words.select(key, F.size("all").alias("size"), F.posexplode("all").alias("off", "term"))


def index_postings(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """The index: positional postings ``(term, doc, pos)`` of the ``terms`` (column ``term``) in all texts, and of each text's ``END``.

    Positions count from 0. Texts are cut into words inside the scan, and only words that are terms leave it.
    """
    words = F.array_append(word_list(F.col(text_col)), F.lit(END))
    rows = docs.select(F.col(id_col).alias("doc"), F.posexplode(words).alias("pos", "term"))
    wanted = terms.select("term").distinct().unionByName(terms.sparkSession.range(1).select(F.lit(END).alias("term")))
    return rows.join(small(wanted, MOST_TERMS), "term").select("term", "doc", "pos")


def frequencies(index: DataFrame) -> DataFrame:
    """``(term, tf)``: the lengths of the index's lists."""
    return index.where(F.col("term") != END).groupBy("term").agg(F.count("*").alias("tf"))


def anchors(places: DataFrame, held: DataFrame, width: int, lists: int = LISTS) -> DataFrame:
    """``(item, start, len, need, off, term)``: for each window of each item the places of its ``lists`` rarest terms.

    A window is ``width`` consecutive words from ``start``; an item of fewer words is one window. A term that a window repeats
    counts once, at its first place; windows of fewer distinct terms have fewer. Windows with a term that no text holds
    can't occur and give none. Overlapping windows share most of their anchors.
    """
    rated = places.join(small(held), "term", "left")
    last = F.greatest(F.col("size") - width, F.lit(0))
    starts = F.sequence(F.greatest(F.col("off") - (width - 1), F.lit(0)), F.least(F.col("off"), last))
    inside = rated.select("item", "size", "off", "term", "tf", F.explode(starts).alias("start"))
    once = inside.groupBy("item", "size", "start", "term", "tf").agg(F.min("off").alias("off"))
    by = Window.partitionBy("item", "start")
    ranked = once.withColumns({
        "nth": F.row_number().over(by.orderBy("tf", "term")), "absent": F.max(F.col("tf").isNull()).over(by), "need": F.least(F.count("*").over(by), F.lit(lists)),
    })
    kept = ranked.where(~F.col("absent") & (F.col("nth") <= lists))
    return kept.select("item", "start", F.least("size", F.lit(width)).cast("int").alias("len"), "need", "off", "term")


def candidates(index: DataFrame, rare: DataFrame) -> DataFrame:
    """``(doc, item, shift, start, len)``: windows whose rarest terms all stand in a text at the right distances.

    Postings are moved by their term's place in the item, so those of one occurrence agree on ``shift``, where the item would
    begin. Keys are (text, item, shift), so a passage that very many texts hold is dealt out by text, and a group holds at
    most an item's anchors.
    """
    moved = index.join(small(rare.select("item", "off", "term").distinct()), "term")
    met = moved.groupBy("doc", "item", (F.col("pos") - F.col("off")).alias("shift")).agg(F.collect_set("off").alias("offs"))
    wins = rare.groupBy("item", "start", "len", "need").agg(F.collect_set("off").alias("wanted"))
    listed = wins.groupBy("item").agg(F.min("need").alias("least"), F.collect_list(F.struct("start", "len", "wanted")).alias("wins"))
    rows = met.join(small(listed), "item").where(F.size("offs") >= F.col("least"))
    whole = F.filter("wins", lambda w: F.size(F.array_except(w["wanted"], "offs")) == 0)
    return rows.select("doc", "item", "shift", F.inline(whole)).select("doc", "item", "shift", "start", "len")


def confirmed(index: DataFrame, found: DataFrame, places: DataFrame, width: int) -> DataFrame:
    """``(doc, item, start, end)``: stretches of texts, in words, in which every word equals the item's at one shift, a window or more of them.

    The lists of all other terms of the candidates' windows are intersected with them: each expected word meets its posting by
    text, position and term. Only the candidates' texts take part. Runs of met words shorter than a window fall away.
    """
    wanted = found.select("doc", "item", "shift", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("off")).distinct()
    wanted = wanted.join(small(places.select("item", "off", "term", "size")), ["item", "off"]).withColumn("pos", F.col("shift") + F.col("off"))
    held = index.join(small(found.select("doc").distinct()), "doc", "left_semi")
    met = wanted.join(held, ["doc", "pos", "term"]).select("doc", "item", "shift", "off", "size").distinct()
    run = F.col("off") - F.row_number().over(Window.partitionBy("doc", "item", "shift").orderBy("off"))
    runs = met.withColumn("run", run).groupBy("doc", "item", "shift", "size", "run").agg(F.min("off").alias("a"), F.max("off").alias("b"))
    long = runs.where(F.col("b") - F.col("a") + 1 >= F.least("size", F.lit(width)))
    return long.select("doc", "item", (F.col("shift") + F.col("a")).alias("start"), (F.col("shift") + F.col("b") + 1).alias("end"))


def phrase_matches(index: DataFrame, places: DataFrame, held: DataFrame, width: int = WINDOW, lists: int = LISTS) -> DataFrame:
    """``(doc, item, start, end)``: the words, ``end`` excluded, that stand inside exact occurrences of an item's windows.

    From the rarest lists outward: the ``lists`` rarest terms of each window give candidates, the other terms' lists confirm them.
    """
    found = store(candidates(index, store(anchors(places, held, width, lists), "anchors")), "candidates")
    return confirmed(index, found, places, width)


def rarest(places: DataFrame, held: DataFrame, terms: int = NEAR_TERMS) -> DataFrame:
    """``(item, term)``: the rarest ``terms`` distinct terms of each item, ties by term; those that no text holds are the rarest, so their items are near nothing."""
    rated = places.select("item", "term").distinct().join(small(held), "term", "left").withColumn("tf", F.coalesce("tf", F.lit(0)))
    order = Window.partitionBy("item").orderBy("tf", "term")
    return rated.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= terms).select("item", "term")


def proximity_matches(index: DataFrame, queries: DataFrame, span: int) -> DataFrame:
    """``(doc, item, start, end)``: places where all terms of a query ``(item, term)`` stand within ``span`` words.

    In any order, repeats allowed. For each posting of a query's term the latest posting of every other term
    at or before it is looked up within the document; ``start`` and ``end`` (inclusive) bound the least such stretch
    that ends there. Pairs of a document and a query of which a term is missing leave before that.
    """
    terms = queries.select("item", "term").distinct()
    need = terms.groupBy("item").agg(F.count("*").alias("need"))
    held = index.join(small(terms.join(need, "item")), "term")
    full = held.groupBy("doc", "item", "need").agg(F.count_distinct("term").alias("n")).where("n = need").select("doc", "item")
    held = held.join(full, ["doc", "item"], "left_semi")
    upto = Window.partitionBy("doc", "item").orderBy("pos").rangeBetween(1 - span, 0)
    near = held.select("doc", "item", "pos", "need", F.collect_list(F.struct("term", "pos")).over(upto).alias("seen"))
    near = near.where(F.size("seen") >= F.col("need"))
    last = near.select("doc", "item", F.col("pos").alias("end"), "need", F.explode("seen").alias("s"))
    last = last.groupBy("doc", "item", "end", "need", "s.term").agg(F.max("s.pos").alias("pos"))
    whole = last.groupBy("doc", "item", "end", "need").agg(F.count("*").alias("n"), F.min("pos").alias("start"))
    return whole.where("n = need").select("doc", "item", "start", "end")


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, ratio: int = 20, span: int = WINDOW,
) -> DataFrame:
    """``(id_col, n_words, n_hit, n_items, n_near, items, items_sha256, contaminated)`` for every document.

    A word is hit if it stands inside an occurrence of a window; a document is contaminated if
    it has a hit and ``ratio`` times its hits reach its words. ``items`` are the ids, as sorted strings, of the
    items with occurring windows; the digest is of their comma-joined list. ``n_near`` counts the items whose
    rarest terms (``NEAR_TERMS``) stand within ``span`` words somewhere, in any order. Null and blank texts
    have no words and no hits. Rows that repeat an id and its text give one row with the same
    figures; an id with several texts gives a row for each. No benchmark, no hits.
    """
    slim = docs.select(F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("body")).alias("doc"), F.col(text_col).alias("text"))
    places = store(item_terms(items, item_col, item_text_col), "terms")
    index = store(index_postings(slim, "doc", "text", places), "postings")
    held = store(frequencies(index), "frequencies")
    hits = store(phrase_matches(index, places, held, width), "matches")
    spans = hits.select("doc", "start", "end").distinct()
    before = Window.partitionBy("doc").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    done = F.greatest(F.col("start"), F.coalesce(F.max("end").over(before), F.lit(0)))
    fresh = spans.withColumn("fresh", F.greatest(F.col("end") - done, F.lit(0)))
    n_hit = fresh.groupBy("doc").agg(F.sum("fresh").cast("long").alias("n_hit"))
    per_doc = hits.groupBy("doc").agg(F.array_sort(F.collect_set(F.col("item.item").cast("string"))).alias("items"))
    near = proximity_matches(index, rarest(places, held), span).groupBy("doc").agg(F.count_distinct("item.item").alias("n_near"))
    sizes = index.where(F.col("term") == END).groupBy("doc").agg(F.max("pos").cast("long").alias("n_words"))
    out = sizes.join(n_hit, "doc", "left").join(per_doc, "doc", "left").join(near, "doc", "left")
    zero = F.lit(0).cast("long")
    n_hit = F.coalesce("n_hit", zero)
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("doc.id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.coalesce("n_near", zero).alias("n_near"),
        listed.alias("items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * ratio >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are not contaminated; a null id is judged by its text like any other."""
    found = contamination(docs.select(F.struct(F.col(id_col), F.xxhash64(text_col)).alias("_row"), text_col), items, "_row", text_col, **how)
    bad = found.where("contaminated").select("_row").distinct()
    own = F.struct(docs[id_col], F.xxhash64(docs[text_col]))
    return docs.join(bad, own.eqNullSafe(F.col("_row")), "left_anti")
