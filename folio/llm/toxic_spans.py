"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.functions.names import free_name
from folio.llm.quality_ranking import descend
from folio.llm.training_rows import PER_CLASS, held_out, labelled_sample

WORD = re.compile(r"[^\W_]+")
STEMS = (3, 4, 5, 6)
"""Lengths of the word beginnings that are features besides the word itself."""
BLOCK = 64
"""Tokens that are worked through one after the other; blocks of a text pass messages on, so its marginals are those of one chain."""
NEAR = 8
"""Words on either side of a marked word that a training window holds."""
LONGEST_WINDOW = 32
"""Words of a training window at most; longer ones are cut."""
UNKNOWN = -1
"""Label of a training word that may be toxic or not."""
SURE = 30.0
"""Log odds that stand for certainty."""
FAINT = 0.05
"""Marginals below this add nothing to a document's score, however many there are."""
CACHED_WORDS = 500_000


def word_features(word: str) -> list[str]:
    """A lower-case word and its beginnings, the latter with a star."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) > n]]


def chain_marginals(emit: np.ndarray, mask: np.ndarray, move: np.ndarray, start: np.ndarray, expect: bool = True):
    """Forward-backward over many two-state chains at once.

    ``emit`` (chains x steps) is the score of state 1 over state 0, ``mask`` marks the steps that a chain has (from
    the first on), ``move`` (2 x 2) and ``start`` (2) are log scores. Returns the marginals of state 1, the expected
    moves (2 x 2) and starts (2), and the sum of the log partition functions; without ``expect`` moves stay 0.
    """
    n, steps = emit.shape
    turn = np.exp(move)
    hot = np.exp(np.clip(emit, -30, 30))
    ahead = np.empty((steps, 2, n))
    scale = np.ones((steps, n))
    a0, a1 = np.full(n, np.exp(start[0])), np.exp(start[1]) * hot[:, 0]
    for t in range(steps):
        if t:
            b0 = a0 * turn[0, 0] + a1 * turn[1, 0]
            b1 = (a0 * turn[0, 1] + a1 * turn[1, 1]) * hot[:, t]
            a0, a1 = np.where(mask[:, t], b0, a0), np.where(mask[:, t], b1, a1)
        scale[t] = a0 + a1
        a0, a1 = a0 / scale[t], a1 / scale[t]
        ahead[t, 0], ahead[t, 1] = a0, a1
    p = np.zeros((n, steps))
    moves = np.zeros((2, 2))
    b0, b1 = np.ones(n), np.ones(n)
    for t in range(steps - 1, -1, -1):
        here0, here1 = ahead[t, 0] * b0, ahead[t, 1] * b1
        p[:, t] = here1 / (here0 + here1)
        if t:
            on = mask[:, t]
            c0, c1 = b0, b1 * hot[:, t]
            if expect:
                total = (here0 + here1) * scale[t]
                for i in (0, 1):
                    for j, c in ((0, c0), (1, c1)):
                        moves[i, j] += (ahead[t - 1, i] * turn[i, j] * c / total)[on].sum()
            n0, n1 = turn[0, 0] * c0 + turn[0, 1] * c1, turn[1, 0] * c0 + turn[1, 1] * c1
            norm = n0 + n1
            b0, b1 = np.where(on, n0 / norm, b0), np.where(on, n1 / norm, b1)
    starts = np.array([(1 - p[:, 0])[mask[:, 0]].sum(), p[:, 0][mask[:, 0]].sum()])
    return p * mask, moves, starts, float(np.log(scale).sum())


def whole_marginals(emit: np.ndarray, mask: np.ndarray, heads: np.ndarray, move: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marginals of state 1 for chains of any length that lie in consecutive rows of ``emit``, each beginning at a row of ``heads``.

    Rows are worked through together: first the product of every row's transfer matrices, then the messages that enter the rows of
    each chain from either side, then all steps inside the rows. The result is that of forward-backward over each chain as a whole.
    """
    n, steps = emit.shape
    turn, begin = np.exp(move), np.exp(start)
    hot = np.exp(np.clip(emit, -SURE, SURE))

    def step(t: int) -> np.ndarray:
        """Transfer matrices (2 x 2 x rows) into step ``t``; a chain's first forgets what came before. Steps that a row lacks change nothing."""
        m = np.empty((2, 2, n))
        for i in (0, 1):
            m[i, 0], m[i, 1] = turn[i, 0], turn[i, 1] * hot[:, t]
            if not t:
                m[i, 0], m[i, 1] = np.where(heads, begin[0], m[i, 0]), np.where(heads, begin[1] * hot[:, t], m[i, 1])
        return np.where(mask[:, t], m, np.eye(2)[:, :, None])

    product = np.repeat(np.eye(2)[:, :, None], n, axis=2)
    for t in range(steps):
        product = np.einsum("ikn,kjn->ijn", product, step(t))
        product /= product.sum((0, 1))
    first = np.flatnonzero(heads)
    place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    levels = np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1])
    ahead, behind = np.zeros((2, n)), np.ones((2, n))
    ahead[0, first] = 1.0
    for rows in levels[1:]:
        m = np.einsum("in,ijn->jn", ahead[:, rows - 1], product[:, :, rows - 1])
        ahead[:, rows] = m / m.sum(0)
    for rows in reversed(levels[1:]):
        m = np.einsum("ijn,jn->in", product[:, :, rows], behind[:, rows])
        behind[:, rows - 1] = m / m.sum(0)
    seen = np.empty((steps, 2, n))
    for t in range(steps):
        ahead = np.einsum("in,ijn->jn", ahead, step(t))
        ahead /= ahead.sum(0)
        seen[t] = ahead
    p = np.zeros((n, steps))
    for t in range(steps - 1, -1, -1):
        here = seen[t] * behind
        p[:, t] = here[1] / here.sum(0)
        behind = np.einsum("ijn,jn->in", step(t), behind)
        behind /= behind.sum(0)
    return p * mask


@dataclass(frozen=True)
class ToxicModel:
    """Feature weights of the toxic state, transition scores, and the calibration of document scores."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -8.0
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    calibration: np.ndarray = field(default_factory=lambda: np.array([-4.0, 0.0, 0.0, 0.0]))

    def emission(self, word: str) -> float:
        return self.bias + sum(self.weights.get(f, 0.0) for f in word_features(word))

    def tag(self, texts: list[str | None], cache: dict[str, float] | None = None) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """The words of each whole text, the marginal of every word in order, and where each text's begin."""
        cache = {} if cache is None else cache
        words = [WORD.findall(t) if t else [] for t in texts]
        if len(cache) > CACHED_WORDS:
            cache.clear()
        emit: list[float] = []
        for w in words:
            for x in w:
                e = cache.get(x)
                if e is None:
                    e = cache[x] = self.emission(x.lower())
                emit.append(e)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        if not len(emit):
            return words, np.zeros(0), begin
        rows = -(-sizes // BLOCK)
        first = np.concatenate([[0], np.cumsum(rows)])[:-1]
        slot = np.repeat(first * BLOCK - begin[:-1], sizes) + np.arange(len(emit))
        grid, mask = np.zeros(rows.sum() * BLOCK), np.zeros(rows.sum() * BLOCK, dtype=bool)
        grid[slot], mask[slot] = emit, True
        heads = np.zeros(rows.sum(), dtype=bool)
        heads[first[sizes > 0]] = True
        p = whole_marginals(grid.reshape(-1, BLOCK), mask.reshape(-1, BLOCK), heads, self.move, self.start)
        return words, p.ravel()[slot], begin

    def summaries(self, p: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Per text of a ``tag`` result: log of one plus the evidence, the greatest marginal, log of one plus the tagged words.

        Evidence is the sum of ``-log(1 - p)``, so it says how sure it is that any word is toxic.
        """
        clear = np.where(p >= FAINT, -np.log(np.maximum(1 - p, 1e-4)), 0.0)
        total = np.concatenate([[0.0], np.cumsum(clear)])
        tagged = np.concatenate([[0], np.cumsum(p >= 0.5)])
        most = np.array([p[a:b].max() if b > a else 0.0 for a, b in zip(begin[:-1], begin[1:], strict=True)])
        out = [np.log1p(np.maximum(total[begin[1:]] - total[begin[:-1]], 0)), most, np.log1p(tagged[begin[1:]] - tagged[begin[:-1]])]
        return np.array(out).T.reshape(-1, 3)

    def document_scores(self, summary: np.ndarray) -> np.ndarray:
        z = self.calibration[0] + summary @ self.calibration[1:]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def spans(self, texts: list[str | None], p: np.ndarray, begin: np.ndarray, least: float = 0.5) -> list[list[dict]]:
        """``{start, end, p}`` of the words tagged toxic in ``tag``'s result, in code points; a run of tagged words is one span."""
        out = []
        for k, text in enumerate(texts):
            own = p[begin[k] : begin[k + 1]]
            found: list[dict] = []
            if len(own) and own.max() >= least:
                last = -2
                for i, m in enumerate(WORD.finditer(text)):
                    if own[i] < least:
                        continue
                    if last == i - 1:
                        found[-1]["end"], found[-1]["p"] = m.end(), max(found[-1]["p"], float(own[i]))
                    else:
                        found.append({"start": m.start(), "end": m.end(), "p": float(own[i])})
                    last = i
            out.append(found)
        return out


def choose_lexicon(documents: list[list[str]], least: int, common: float = 0.03) -> list[str]:
    """Features that explain the toxic documents, of those given for each.

    First a greedy cover: features that each explain at least ``least`` documents that no earlier one does, the longest
    first of those that explain equally many, so a stem is as long as its evidence allows. Then those that ``common``
    of the documents hold, for a document often has several kinds of toxic words; but none that begins a chosen
    one or is begun by one. Rare words that go along with others, such as those of copies, are left out.
    """
    holders: dict[str, set[int]] = {}
    for k, fs in enumerate(documents):
        for f in fs:
            holders.setdefault(f, set()).add(k)
    order = sorted(holders, key=lambda f: (-len(holders[f]), -len(f), f))
    rest, chosen = dict(holders), []
    while rest:
        best = max(rest, key=lambda f: (len(rest[f]), len(f), f))
        gone = rest.pop(best)
        if len(gone) < least:
            break
        chosen.append(best)
        rest = {f: left for f, held in rest.items() if len(left := held - gone) >= least}
    for f in order:
        stem = f.rstrip("*")
        if len(holders[f]) < max(least, common * len(documents)):
            break
        if not any(stem.startswith(c.rstrip("*")) or c.startswith(stem) for c in chosen):
            chosen.append(f)
    return chosen


def fit_chain(windows: list[list[str]], labels: list[list[int]], features: list[str], ridge: float = 1e-4, steps: int = 150) -> ToxicModel:
    """Conditional likelihood of labelled word windows, maximised by Adam over all windows at once.

    ``UNKNOWN`` labels are summed over: what the model expects of moves and states is held against what it expects given the known
    labels, so features that no labelled toxic word has can gain weight from the words they stand beside.
    """
    at = {f: i for i, f in enumerate(features)}
    n, longest = len(windows), max(map(len, windows))
    mask, y = np.zeros((n, longest), dtype=bool), np.zeros((n, longest))
    tokens, held = [], []
    for k, (ws, ls) in enumerate(zip(windows, labels, strict=True)):
        mask[k, : len(ws)] = True
        y[k, : len(ls)] = ls
        for t, w in enumerate(ws):
            for f in word_features(w):
                if f in at:
                    tokens.append(k * longest + t)
                    held.append(at[f])
    tokens, held = np.array(tokens, dtype=np.int64), np.array(held, dtype=np.int64)
    known = np.where(y == UNKNOWN, 0.0, np.where(y == 1, SURE, -SURE))
    d = len(features)
    theta, m, v = np.zeros(d + 7), np.zeros(d + 7), np.zeros(d + 7)
    for step in range(1, steps + 1):
        emit = np.bincount(tokens, weights=theta[held], minlength=n * longest).reshape(n, longest) + theta[d]
        p, moves, starts, _ = chain_marginals(emit, mask, theta[d + 1 : d + 5].reshape(2, 2), theta[d + 5 :])
        q, seen_moves, seen_starts, _ = chain_marginals(emit + known, mask, theta[d + 1 : d + 5].reshape(2, 2), theta[d + 5 :])
        off = (p - q).ravel()
        g = np.concatenate([
            np.bincount(held, weights=off[tokens], minlength=d), [off.sum()],
            (moves - seen_moves).ravel(), starts - seen_starts,
        ]) / n + ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return ToxicModel(dict(zip(features, theta[:d].tolist(), strict=True)), float(theta[d]), theta[d + 1 : d + 5].reshape(2, 2), theta[d + 5 :])


def candidate_features(sample: DataFrame, toxic: int, clean: int, precision: float = 0.97) -> list[str]:
    """Features that at least 0.4 % of the toxic sample texts hold and that point at toxic texts with ``precision``.

    Counted by texts over the sample, classes weighing the same; the distinct features of a text are exploded and
    counted with map-side combining. All that qualify come back: at most 250 for each feature that a toxic text has on average.
    """

    @F.pandas_udf("array<string>")
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted({f for w in set(WORD.findall(t.lower() if t else "")) for f in word_features(w)}) for t in texts], dtype=object)

    held = sample.select("_label", F.explode(distinct("_text")).alias("f"))
    tally = held.groupBy("f").agg(F.sum("_label").alias("bad"), F.sum(1 - F.col("_label")).alias("good"))
    share = (F.col("bad") / toxic) / (F.col("bad") / toxic + F.col("good") / clean)
    least = max(3, int(0.004 * toxic))
    kept = tally.where((F.col("bad") >= least) & (share >= precision))
    return sorted(r["f"] for r in kept.select("f").collect())


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> ToxicModel:
    """Fit on a bounded labelled sample; without both classes the model finds nothing.

    Documents carry labels, words do not: words that hold a feature of the lexicon are labelled toxic in toxic
    documents, those that hold another candidate feature are left open, all others and those of clean documents are clean. The
    chain is fitted over all candidate features, on windows around such words and one window of every text; document scores by logistic loss on the marginals' summaries, each
    sampled row weighing as many as its class has rows for it.
    """
    sample, counts = labelled_sample(docs, labels, label_col, id_col, text_col, per_class)
    sample = sample.persist()
    try:
        sizes = {r["_label"]: r["count"] for r in sample.groupBy("_label").count().collect()}
        if not sizes.get(0) or not sizes.get(1):
            return ToxicModel()
        known = candidate_features(sample, sizes[1], sizes[0])
        known_set = frozenset(known)

        @F.pandas_udf("array<string>")
        def held(texts: pd.Series) -> pd.Series:
            return pd.Series([sorted(known_set.intersection(f for w in set(WORD.findall(t.lower() if t else "")) for f in word_features(w))) for t in texts], dtype=object)

        bad = sample.where("_label = 1").select("_id", held("_text").alias("fs")).toPandas().sort_values("_id", kind="stable")
        lexicon = choose_lexicon([list(fs) for fs in bad["fs"]], max(3, int(0.004 * sizes[1])))
        if not lexicon:
            return ToxicModel()
        chosen = frozenset(lexicon)
        features = sorted(known_set | chosen)

        @F.pandas_udf("array<struct<words:array<string>,labels:array<int>>>")
        def windows(texts: pd.Series, marks: pd.Series) -> pd.Series:
            out = []
            for t, mark in zip(texts, marks, strict=True):
                ws = WORD.findall(t.lower() if t else "")
                held_at, ys = [], [0] * len(ws)
                for i, w in enumerate(ws):
                    own = word_features(w)
                    if not known_set.isdisjoint(own):
                        held_at.append(i)
                        ys[i] = 0 if not mark else 1 if not chosen.isdisjoint(own) else UNKNOWN
                cuts: list[list[int]] = []
                for i in sorted([*held_at, len(ws) // 2]) if ws else []:
                    a, b = max(0, i - NEAR), min(len(ws), i + NEAR + 1)
                    if cuts and a <= cuts[-1][1] and b - cuts[-1][0] <= LONGEST_WINDOW:
                        cuts[-1][1] = b
                    else:
                        cuts.append([max(a, cuts[-1][1]) if cuts else a, b])
                out.append([{"words": ws[a:b], "labels": ys[a:b]} for a, b in cuts if b > a])
            return pd.Series(out, dtype=object)

        cut = sample.select("_id", F.explode(windows("_text", "_label")).alias("w")).select("_id", "w.words", "w.labels")
        got = cut.toPandas()
        got = got.assign(k=got["words"].map(" ".join)).sort_values(["_id", "k"], kind="stable")
        chain = fit_chain([list(w) for w in got["words"]], [list(y) for y in got["labels"]], features)

        @F.pandas_udf("array<double>")
        def summed(texts: pd.Series) -> pd.Series:
            return pd.Series(chain.summaries(*chain.tag(list(texts))[1:]).tolist(), dtype=object)

        rows = sample.select("_id", "_label", summed("_text").alias("x")).toPandas().sort_values("_id", kind="stable")
        x = np.hstack([np.ones((len(rows), 1)), np.array(rows["x"].tolist())])
        y = rows["_label"].to_numpy(dtype=float)
        weigh = np.where(y == 1, counts[1] / sizes[1], counts[0] / sizes[0])
        calibration = descend(x, y, weigh, 1e-2)
        return ToxicModel(chain.weights, chain.bias, chain.move, chain.start, calibration)
    finally:
        sample.unpersist()


def tag_documents(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``spans`` (``array<struct<start,end,p>>``) of every whole text.

    Null and empty texts score like texts without any toxic word and have no spans; rows stay as they are. Columns of
    these names are replaced.
    """

    @F.pandas_udf("struct<score:double,spans:array<struct<start:int,end:int,p:double>>>")
    def tagged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict[str, float] = {}
        for texts in batches:
            scores, spans = [], []
            for at in range(0, len(texts), 500):
                part = list(texts.iloc[at : at + 500])
                _, p, begin = model.tag(part, cache)
                scores += model.document_scores(model.summaries(p, begin)).tolist()
                spans += model.spans(part, p, begin)
            yield pd.DataFrame({"score": pd.Series(scores, dtype=float), "spans": pd.Series(spans, dtype=object)})

    name = free_name(docs.columns, "tagged")
    return docs.withColumn(name, tagged(F.col(text_col))).withColumns({"score": F.col(f"{name}.score"), "spans": F.col(f"{name}.spans")}).drop(name)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score, predicted, spans)`` of every row of ``docs``."""
    slim = docs.select("doc_id", "text")
    tagged = tag_documents(slim, learn(slim, labels))
    return tagged.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans"
    )
