"""LSH forest, conversation tries and source divergence against brute force and SQL."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from compare import run_sql, same_rows
from conftest import LARGER, SMALL
from pyspark.sql import functions as F

from folio.llm import conversation_trie, minhash_forest, oracles, queries, source_divergence

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


# near duplicates


def brute_classes(rows):
    """``{(id, text): (n, component)}`` by all pairs."""

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted(((key, len(sets[i]), least.get(find(i)), key == least.get(find(i))) for i, (key, _) in enumerate(rows)), key=str)


def got_classes(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("seed", range(2))
def test_classes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for base in range(12):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 8, 60, 150]))]
        if base % 3 == 0:
            words += passage
        for copy in range(rng.randrange(1, 8)):
            rows.append((len(rows), " ".join(edited(rng, words, rng.randrange(4) if copy else 0))))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, rows[0][1].upper().replace("X", "x").replace("W", "w").replace("P", "p"))]
    assert got_classes(minhash_forest.near_duplicates(documents(spark, rows))) == brute_classes(rows)


def test_a_crowd_of_near_copies_and_a_common_passage(spark, monkeypatch):
    """Far more members than a region takes: found by longer prefixes, by stars, and those a star misses by the exact rest."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, words, 1 + i % 3))) for i in range(150)]
    passage = [f"p{i}" for i in range(50)]
    rows += [(1000 + i, " ".join([*passage, *[f"u{rng.randrange(10**6)}" for _ in range(30)]])) for i in range(150)]
    rows += [(2000 + i, rows[160 + i][1] + " end") for i in range(10)]
    assert got_classes(minhash_forest.near_duplicates(documents(spark, rows))) == brute_classes(rows)
    # as if whole signatures were two values: crowds of unlike texts
    monkeypatch.setattr(minhash_forest, "DEPTHS", (1,))
    monkeypatch.setattr(minhash_forest, "REGION", 2)
    monkeypatch.setattr(minhash_forest, "_prefix", lambda depth: F.lit(0).cast("long"))
    few = rows[:20] + rows[150:165] + rows[300:]
    assert got_classes(minhash_forest.near_duplicates(documents(spark, few))) == brute_classes(few)


def test_pairs_that_the_cut_of_a_crowded_region_parts_are_found_again(spark, monkeypatch):
    """One region of all texts, cut by whole signatures: every near pair is parted."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(40)]
    rows = [(i, " ".join([*passage, *[f"u{rng.randrange(10**6)}" for _ in range(40)]])) for i in range(30)]
    rows += [(100 + i, rows[i][1] + " end") for i in range(12)]
    monkeypatch.setattr(minhash_forest, "DEPTHS", (1, minhash_forest.VALUES))
    monkeypatch.setattr(minhash_forest, "REGION", 2)
    prefix = minhash_forest._prefix
    monkeypatch.setattr(minhash_forest, "_prefix", lambda depth: F.lit(0).cast("long") if depth == 1 else prefix(depth))
    found = got_classes(minhash_forest.near_duplicates(documents(spark, rows)))
    assert found == brute_classes(rows) and sum(not kept for *_, kept in found) == 12


def test_class_edge_cases(spark):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (9, "One  two"), (10, text), (None, text), (3, text), (3, text), (3, "other words here"), (None, "alone"), (11, "x " * 30_000)]
    assert got_classes(minhash_forest.near_duplicates(documents(spark, rows))) == sorted(
        [
            (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 1, 8, True), (9, 1, 8, False), (10, 36, 3, False), (None, 36, 3, False),
            (3, 36, 3, True), (3, 36, 3, True), (3, 1, 3, True), (None, 1, None, True), (11, 1, 11, True),
        ],
        key=str,
    )
    assert minhash_forest.near_duplicates(documents(spark, [])).count() == 0
    named = spark.createDataFrame([("b", text, 1, 2, 3), ("a", text, 1, 2, 3)], "key string, body string, node int, root int, n int")
    assert {tuple(r) for r in minhash_forest.near_duplicates(named, "key", "body").collect()} == {("a", 36, "a", True), ("b", 36, "a", False)}


def test_signatures_estimate_overlap():
    rng = np.random.default_rng(3)
    shared = rng.integers(0, 1 << 63, 900, dtype=np.uint64)
    a = np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    b = np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 50, dtype=np.uint64)]))
    agree = (minhash_forest.signature(a) == minhash_forest.signature(b)).mean()
    assert abs(agree - 0.9) < 0.1
    assert (minhash_forest.signature(a) == minhash_forest.signature(np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64)))).sum() == 0


def test_profiles_keep_every_link_and_spare_pairs_below_it(spark, monkeypatch):
    """Only pairs that their profiles allow carry both sets; those allow all links and few pairs of an overlap of seven tenths."""
    rng = np.random.default_rng(5)
    pairs, links = [], []
    for n in (1, 40, 400, 2000, 30_000, 300_000):
        shared, own = rng.integers(0, 1 << 64, n, dtype=np.uint64), rng.integers(0, 1 << 64, n, dtype=np.uint64)
        for part in (0, 0.05, 0.08, 0.2, 0.3):
            k = int(n * part)
            a, b = np.sort(np.concatenate([shared[k:], own[:k]])), np.sort(shared)
            both = len(np.intersect1d(a, b))
            pairs.append((minhash_forest.profile(a), minhash_forest.profile(b)))
            links.append(100 * both >= 85 * (len(a) + len(b) - both))
    may = list(minhash_forest.may_link(*(pd.Series(x) for x in zip(*pairs, strict=True))))
    assert all(m for m, linked in zip(may, links, strict=True) if linked) and sum(links) == 20
    assert not any(may[9:20:5]) and all(may[25:])

    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*words[:320], *[f"u{i}_{j}" for j in range(80)]])) for i in range(20)] + [(100, " ".join([*words[:320], *[f"u7_{j}" for j in range(79)]]))]
    carried, seen = [], minhash_forest.store
    monkeypatch.setattr(minhash_forest, "store", lambda df, name: (carried.append((name, out := seen(df, name))), out)[1])
    assert got_classes(minhash_forest.near_duplicates(documents(spark, rows))) == brute_classes(rows)
    total = lambda name: sum(df.count() for n, df in carried if n == name)
    assert total("candidates") > 20 and total("near-candidates") == 1


@pytest.mark.parametrize("folder", [SMALL, LARGER])
def test_recall_of_the_forest(spark, folder):
    """Against all pairs: every link of the tables, whose near copies stand at and above the threshold, is found."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: r for r in queries.op11_minhash_forest(spark, folder).collect()}
    assert len(got) == len(rows)
    sets = {i: minhash_forest.shingle_set(t) for i, t in rows}
    by_hash = defaultdict(list)
    for i, s in sets.items():
        for h in s.tolist():
            by_hash[h].append(i)
    shared = Counter(p for ids in by_hash.values() if len(ids) > 1 for p in combinations(sorted(ids), 2))
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n)]
    assert links and all(got[a]["component_id"] == got[b]["component_id"] for a, b in links)
    assert all(got[i]["n_shingles"] == len(s) for i, s in sets.items())


def test_forest_query_equals_sql(spark):
    same_rows(queries.op11_minhash_forest(spark, SMALL), run_sql(oracles.OP11, SMALL))


# conversations

TURNS = "conv_id long, turn long, role string, text string, words int"


def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.md5((role or "").encode()).hexdigest(), hashlib.md5((text or "").encode()).hexdigest(), role or "", text or ""))
    own = {c: [t[4:] for t in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seq = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, d == len(seq)))
    out = []
    for key, held in members.items():
        below = [k for k in members if k[: len(key)] == key]
        children = [k for k in below if len(k) == len(key) + 1]
        leaves = [k for k in below if not any(j[: len(k)] == k and len(j) == len(k) + 1 for j in below)]
        saved = sum((len(members[k]) - 1) * len(k[-1][1].split()) for k in below if k)
        ends = ",".join(map(str, sorted(c for c, end in held if end)))
        parent = min(c for c, _ in members[key[:-1]]) if key else None
        out.append((min(c for c, _ in held), len(key), parent, len(held), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def got_trie(spark, rows, most_turns=conversation_trie.MOST_TURNS):
    lists = conversation_trie.turn_lists(spark.createDataFrame([(*r, 9) for r in rows], TURNS))
    found = conversation_trie.prefix_trie(conversation_trie.rebuilt(lists), most_turns)
    assert found.columns == COLUMNS
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("most_turns", [2, 12, 4096])
def test_trie_equals_brute_force(spark, most_turns):
    """Few turns a subtrie mean many rounds, stems of several turns and lists that end within them."""
    rng = random.Random(most_turns)
    rows = []
    opening = [("user", f"hello {i} there") for i in range(5)]
    for conv in range(45):
        kind = rng.randrange(4)
        turns = (opening[: rng.randrange(6)] if kind else []) + [(rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None])) for _ in range(rng.randrange(4))]
        turns = turns or [("user", "x")]
        rows += [(conv, i, role, text) for i, (role, text) in enumerate(turns)]
    assert got_trie(spark, rows, most_turns) == brute_trie(rows)


def test_trie_edge_cases(spark):
    assert got_trie(spark, []) == []
    assert got_trie(spark, [(None, 0, "user", "x")]) == []
    # 25 loses its head of turns and has no block's first: it ends at the root if its head is all it has
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(200)}
    bare = next(c for c in h if h[c] == 3 and c % 20)
    rows = [(bare, None, None, None), (bare, 1, "user", "a"), (7, 2, "user", "late"), (7, None, "user", "first"), (7, 2, "user", "late"), (-21, 1, "bot", "minus"), (-20, 1, "bot", "head")]
    assert got_trie(spark, rows) == brute_trie(rows)
    long = [(c, i, "user", f"t{i}" if i < 3000 or c < 42 else f"{c}") for c in (40, 41, 42, 43) for i in range(3001)]
    found = got_trie(spark, long, 5000)
    assert len(found) == 1 + 3000 + 3 and max(r[1] for r in found) == 3001


def test_trie_hashes_many_ids_in_order(spark):
    """Equal conversations over several ranges of ids are hashed as one text."""
    lists = spark.range(9000).select(F.col("id").alias("conv"), F.array(F.struct(F.lit(b"1" * 16).alias("digest"), F.lit(2).cast("long").alias("words"))).alias("seq"))
    got = {r["depth"]: r for r in conversation_trie.prefix_trie(lists).collect()}
    assert got[1]["ends_sha256"] == hashlib.sha256(",".join(map(str, range(9000))).encode()).hexdigest()
    assert (got[1]["saved_tokens"], got[0]["ends_sha256"], got[0]["n_children"]) == (8999 * 2, conversation_trie.NO_IDS, 1)


@pytest.mark.parametrize("folder", [SMALL, LARGER])
def test_trie_query_equals_sql(spark, folder):
    same_rows(queries.op12_conversation_trie(spark, folder), run_sql(oracles.OP12, folder))


# divergence


def brute_divergence(rows, top=200):
    words = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        w = words(text)
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        held[lang].update(set(w))
        counts[lang, source].update(w)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for t, n in held[lang].items() if n >= 3), key=str.encode)
        sources = sorted(s for x, s in groups if x == lang)

        def shares(count):
            total = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        far = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            parts = {"pair": [(o, sum(far(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]}
            parts["term"] = [(t, far(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in parts.items():
                ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ordered[: top if part == "term" else None], 1)]
    return sorted(out)


def got_divergence(spark, rows):
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "text string, lang string, source string, n long, term int")
    return sorted(tuple(r) for r in source_divergence.divergence(table).select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    terms = ["the", "The", "été", "Été", "z", "naïve", "ﬁ", "𝒳", "don't", "a1b", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]]
    rows = [(" ".join(rng.choices(terms, k=rng.randrange(120))), rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "é", "", None])) for _ in range(90)]
    rows += [(None, "de", "only"), ("none twice", "de", "other"), ("", "xx", "alone")]
    expected = brute_divergence(rows)
    assert got_divergence(spark, rows) == expected
    monkeypatch.setattr(source_divergence, "CELLS", 100)  # many chunks a language
    monkeypatch.setattr(source_divergence, "TOP", 5)
    few = [r for r in expected if r[2] == "pair" or r[5] <= 5]
    assert got_divergence(spark, rows) == few


def test_divergence_edge_cases(spark):
    assert got_divergence(spark, []) == []
    assert got_divergence(spark, [(None, None, None)]) == []
    assert got_divergence(spark, [("a", "x", "s"), ("b", "x", "t"), ("b", "x", "t")]) == [("x", "s", "pair", "t", 0, 1), ("x", "t", "pair", "s", 0, 1)]
    long = [("word " * 200_000 + "other", "x", "s")] * 3 + [("word", "x", "t")]
    assert got_divergence(spark, long) == brute_divergence(long)


def test_shares_are_exact():
    counts = np.array([1, 7, 10**12, 8 * 10**15], dtype=np.int64)
    for total in (1, 3, 10**12 + 39, 8 * 10**15 + 1):
        parts = counts[counts <= total]
        assert source_divergence.share(parts, total).tolist() == [10**9 * int(c) // total for c in parts]


@pytest.mark.parametrize("folder", [SMALL, LARGER])
def test_divergence_query_equals_sql(spark, folder):
    same_rows(queries.op13_source_divergence(spark, folder), run_sql(oracles.OP13, folder))


def test_long_batches_are_coded_in_parts():
    text = "word other " * 400
    part = pd.DataFrame({"lang": "en", "source": "web", "text": [text] * 4000})
    coded = list(source_divergence._counts(iter([part])))
    # 17.6 million characters: never more than some four million at a time
    assert len(coded) >= 4
    assert pd.concat(coded).groupby("term")[["n", "docs"]].sum().to_numpy().tolist() == [[1_600_000, 4000]] * 2
