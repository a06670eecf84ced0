"""Audit of how far sources diverge within a language, over integer-coded terms."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.plans.lineage import store
from folio.plans.sizes import small

LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
"""A-Z lower-cased, other ASCII but a-z a blank; bytes beyond ASCII stay."""
SCALE_STEPS = 3
"""Shares are counted in units of 1000 ** -3."""
SLICE = 1 << 22
"""Characters that are coded together; a longer text is coded alone."""
CELLS = 500_000
"""Counts, sources times terms, that one dense chunk holds."""
LEAST_DOCS = 3
TOP = 200


def terms(text: str) -> list[bytes]:
    """Runs of letters, marks beyond ASCII included, as UTF-8."""
    return text.encode().translate(LETTERS).split()


def share(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``floor(10**9 * counts / total)`` by long division in base 1000: exact in 64 bits for totals below 9 * 10**15."""
    done, rest = np.divmod(counts, total)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * 1000, total)
        done = done * 1000 + digit
    return done


def _coded(part: pd.DataFrame) -> pd.DataFrame:
    """Occurrences and documents of every ``(lang, source, term)`` of some rows."""
    part = part.reset_index(drop=True)
    group = part.groupby(["lang", "source"], sort=False).ngroup().to_numpy(dtype=np.int64)
    words = [terms(t) for t in part["text"]]
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.empty(int(sizes.sum()), dtype=object)
    flat[:] = list(chain.from_iterable(words))
    codes, names = pd.factorize(flat)
    codes, width, doc = codes.astype(np.int64), max(len(names), 1), np.repeat(np.arange(len(words)), sizes)
    cells, n = np.unique(group[doc] * width + codes, return_counts=True)
    once = np.unique(doc * width + codes)
    _, held = np.unique(group[once // width] * width + once % width, return_counts=True)
    first = part.loc[np.unique(group, return_index=True)[1], ["lang", "source"]].to_numpy(dtype=object)
    own = first[cells // width]
    return pd.DataFrame({"lang": own[:, 0], "source": own[:, 1], "term": names[cells % width], "n": n, "docs": held})


def _counts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if len(frame):
            for _, part in frame.groupby((frame["text"].str.len().cumsum() // SLICE).to_numpy()):
                yield _coded(part)


COUNTED = "lang string, source string, term binary, n long, docs long"
FOUND = "lang string, source string, part string, item binary, value long"


def _chunk(key: tuple, counted: pd.DataFrame, groups: pd.DataFrame) -> pd.DataFrame:
    """Partial ``pair`` sums and the first ``TOP`` of every group's ``term`` rows over one chunk of a language's kept terms."""
    groups = groups.sort_values("source", ignore_index=True)
    sources, kinds = groups["source"].to_numpy(dtype=object), int(groups["kinds"].iloc[0])
    held = counted["term"].to_numpy(dtype=object)
    dictionary = np.array(sorted(set(held)), dtype=object)
    ids = np.searchsorted(dictionary, held).astype(np.int64)
    row = pd.Index(sources).get_indexer(counted["source"]).astype(np.int64)
    width = len(dictionary)
    # each cell has one addend, so doubles hold it exactly
    cells = np.bincount(row * width + ids, weights=counted["n"], minlength=len(sources) * width).astype(np.int64).reshape(len(sources), width)
    rows = []
    if width:
        totals = groups["total"].to_numpy(dtype=np.int64)
        p = 1 + share(cells + 1, (totals + kinds)[:, None])
        q = 1 + share(cells.sum(axis=0) + 1, int(groups["of_lang"].iloc[0]) + kinds)
    for at, source in enumerate(sources):
        far = ((p[at] - p) ** 2 // p).sum(axis=1) if width else np.zeros(len(sources), dtype=np.int64)
        others = np.arange(len(sources)) != at
        rows.append(pd.DataFrame({"source": source, "part": "pair", "item": [s.encode() for s in sources[others]], "value": far[others]}))
        if width:
            over = np.flatnonzero((cells[at] > 0) & (p[at] > q))
            value = (p[at, over] - q[over]) ** 2 // q[over]
            first = np.lexsort((over, -value))[:TOP]
            rows.append(pd.DataFrame({"source": source, "part": "term", "item": dictionary[over[first]], "value": value[first]}))
    return pd.concat(rows, ignore_index=True).assign(lang=key[0])[["lang", "source", "part", "item", "value"]]


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how each source of a language differs from the others and from the whole.

    A language keeps the terms that at least ``LEAST_DOCS`` of its rows hold; counts are smoothed by one and scaled to integers, so all
    results are exact. ``pair`` rows compare a source with every other one, ``term`` rows are the terms it uses more than its language.
    Nulls in the three columns count as the empty string, rows that repeat count each time, other columns are not read, texts without
    terms still make their group known; an empty table gives no row, a language without kept terms pairs of value 0. Ties come in
    UTF-8 order.

    Texts are coded where they are read: the words of an Arrow batch become integers and each (group, term) is counted once before
    anything is shuffled. Kept terms of a language are dealt over chunks whose dense counts (sources times terms) stay within ``CELLS``;
    a chunk's sorted array gives its terms ids in UTF-8 order. No task holds a whole language or vocabulary. Pairs of sources are
    the result itself and grow with the square of a language's sources.
    """
    empty = F.lit("")
    slim = docs.select(*[F.coalesce(F.col(c), empty).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    # one exchange for the counts, the documents of a term and the filter on them
    dealt = slim.mapInPandas(_counts, COUNTED).repartition("lang", "term")
    counts = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    held = counts.withColumns({"in_lang": F.sum("docs").over(whole), "first": F.col("source") == F.min("source").over(whole)})
    kept = store(held.where(F.col("in_lang") >= LEAST_DOCS).select("lang", "term", "source", "n", "first"), "kept-terms")

    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("kinds"))
    groups = slim.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["total", "kinds"])
    groups = store(groups, "source-totals")
    langs = groups.groupBy("lang").agg(F.sum("total").alias("of_lang"), F.sum("kinds").alias("kinds"), F.count("*").alias("sources"))
    chunks = F.greatest(F.ceil(F.col("kinds") * F.col("sources") / CELLS), F.lit(1))
    langs = store(langs.withColumn("chunks", chunks.cast("long")), "langs")
    at = F.pmod(F.xxhash64("term"), F.col("chunks"))
    coded = kept.join(small(langs.select("lang", "chunks")), "lang").select("lang", at.alias("chunk"), "term", "source", "n")
    sides = groups.drop("kinds").join(small(langs), "lang").select(
        "lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "source", "total", "of_lang", "kinds"
    )
    found = coded.groupBy("lang", "chunk").cogroup(sides.groupBy("lang", "chunk")).applyInPandas(_chunk, FOUND)
    found = store(found.withColumn("item", F.col("item").cast("string")), "divergences")

    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)
