"""Decontamination, sharding, mixing, near duplicates, syncmers and secrets against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from compare import canonical, run_sql, same_rows
from conftest import LARGER, SMALL
from pyspark.sql import functions as F

from folio.llm import decontamination, secret_scan, sharding, simhash_dedup, source_mixing, syncmers
from folio.llm import oracles, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# decontamination


def brute_contamination(docs, items, width=13):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    wins = defaultdict(set)
    for key, text in items:
        w = cut(text)
        for i in range(max(len(w) - width + 1, 1) if w else 0):
            wins[tuple(w[i : i + width])].add(str(key))
    lengths = {len(k) for k in wins}
    out = []
    for key, text in docs:
        w = cut(text)
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[g]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination_equals_brute_force(spark):
    rng = random.Random(1)
    words = ["a", "b", "Cé", "d9", "été"]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 3, 13, 15, 20])))) for k in range(12)]
    items += [(100, ""), (101, None), (102, items[3][1]), (103, "a a a a a a a a a a a a a")]
    docs = []
    for k in range(150):
        body = " ".join(rng.choices(words, k=rng.randrange(0, 60)))
        if k % 3 == 0:
            body += "; " + (rng.choice(items)[1] or "").upper()
        docs.append((k, body))
    docs += [(500, None), (501, ""), (502, "a " * 3000), (503, items[4][1]), (504, "b " * 60000 + (items[5][1] or ""))]
    d = documents(spark, [(k, t, "s") for k, t in docs])
    i = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(d, i).drop("items").select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"
    )
    assert sorted(tuple(r) for r in got.collect()) == brute_contamination(docs, items)


def test_decontamination_query_equals_sql(spark):
    same_rows(queries.op2_decontamination(spark, SMALL), run_sql(oracles.OP2, SMALL))


def test_contamination_edge_cases(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, [(1, "a b", "s"), (1, "a b", "s"), (1, "c", "s"), (None, "a", "s")])
    got = decontamination.contamination(docs, none).select("doc_id", "n_words", "n_hit", "contaminated")
    assert sorted(got.collect(), key=str) == sorted([(1, 2, 0, False), (1, 1, 0, False), (None, 1, 0, False)], key=str)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    kept = decontamination.drop_contaminated(docs.withColumn("words", F.lit(1)).withColumn("doc", F.lit(2)), items)
    assert [(r["doc_id"], r["text"], r["words"]) for r in kept.collect()] == [(1, "c", 1)]
    empty = documents(spark, [])
    assert decontamination.contamination(empty, items).count() == 0


def brute_near(docs, items, span=13, terms=3):
    """``(doc, item)`` pairs whose rarest terms stand within ``span`` words, by sliding over every text."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    tf = Counter(w for _, t in docs for w in cut(t))
    out = set()
    for item, text in items:
        rare = set(sorted({w for w in cut(text) if tf[w]}, key=lambda w: (tf[w], w))[:terms])
        for doc, body in docs:
            w = cut(body)
            if rare and any(rare <= set(w[i : i + span]) for i in range(max(len(w) - span + 1, 1))):
                out.add((doc, item))
    return out


def index_of(docs, items):
    places = decontamination.item_terms(items, "item_id", "text")
    index = decontamination.index_postings(docs, "doc_id", "text", places)
    return index, places, decontamination.frequencies(index)


def test_proximity(spark):
    docs = documents(spark, [(1, "x a y b z", "s"), (2, "a p q r s b", "s"), (3, "b a", "s"), (4, "a a", "s")])
    asks = spark.createDataFrame([(7, "A b"), (8, "")], "item_id long, text string")
    index, places, _ = index_of(docs, asks)
    got = decontamination.proximity_matches(index, places, span=3).select("doc", "item.item", "start", "end")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 7, 1, 3), (3, 7, 0, 1)]


def test_an_item_with_a_term_that_no_text_holds_is_near_nothing(spark):
    docs = documents(spark, [(1, "the end", "s"), (2, "the xxx yyy zzz", "s")])
    asks = spark.createDataFrame([(7, "the zzz yyy qqq"), (8, "the end"), (9, "the zzz yyy xxx")], "item_id long, text string")
    got = {r["doc_id"]: r["n_near"] for r in decontamination.contamination(docs, asks).collect()}
    assert got == {1: 1, 2: 1}


def test_rarest_terms_give_candidates_and_the_other_lists_confirm(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([2, 13, 14, 30])))) for k in range(8)]
    docs = []
    for k in range(60):
        body = rng.choices(words, k=rng.randrange(0, 40))
        copy = items[k % 8][1].split()
        if k % 2:
            copy[rng.randrange(len(copy))] = "other"
        docs.append((k, " ".join(body + copy + body[:5])))
    d, i = documents(spark, [(k, t, "s") for k, t in docs]), spark.createDataFrame(items, "item_id long, text string")
    index, places, held = index_of(d, i)
    rare = decontamination.anchors(places, held, 13)
    found = decontamination.candidates(index, rare)
    first = {(r["doc"], r["item"]["item"], r["shift"] + r["start"], r["len"]) for r in found.collect()}
    exact = set()
    for doc, text in docs:
        w = text.split()
        for item, body in items:
            b = body.split()
            n = min(len(b), 13)
            exact |= {(doc, item, at, n) for s in range(len(b) - n + 1) for at in range(len(w) - n + 1) if w[at : at + n] == b[s : s + n]}
    assert exact < first and len(exact) > 50
    got = decontamination.contamination(d, i)
    near = Counter(doc for doc, _ in brute_near(docs, items))
    assert {r["doc_id"]: r["n_near"] for r in got.collect()} == {k: near[k] for k, _ in docs}
    own = got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(tuple(r) for r in own.collect()) == brute_contamination(docs, items)


# sharding


def scalar_jump(key, shards):
    key &= (1 << 64) - 1
    at, ahead = -1, 0
    while ahead < shards:
        at = ahead
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        ahead = int((at + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return at


def test_jump_equals_scalar():
    keys = np.array([0, 1, -1, 2**63 - 1, *np.random.default_rng(0).integers(-(2**62), 2**62, 300)], dtype=np.int64)
    for n in (1, 2, 24, 25, 1000):
        assert sharding.jump(keys, n).tolist() == [scalar_jump(int(k), n) for k in keys]


def test_sharding_query(spark):
    got = queries.op3_sharding(spark, LARGER).toPandas()
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").toPandas()
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    assert sorted(got["doc_id"]) == sorted(docs["doc_id"])
    for r in got.itertuples():
        body = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(body) + 8, zlib.crc32(body), "key")
        assert r.shard == scalar_jump(r.doc_id, 24) and r.grown_shard in (r.shard, 24)
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    assert 0 < (got["grown_shard"] == 24).mean() < 0.1


def test_sharding_edge_cases(spark):
    rows = documents(spark, [(None, "a", "s"), (None, "a", "s"), (5, None, "s"), (5, None, "s"), (5, "x", "s")])
    got = sharding.assign_shards(rows.withColumn("slot", F.lit("old")).withColumn("_bucket", F.lit(3)), "doc_id", 3, rows_per_bucket=1)
    assert got.count() == 5
    for _, own in got.toPandas().groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    kept = sharding.assign_shards(documents(spark, [(1, "w " * 300_000, "s"), (2, "x", "s")]).withColumn("_bucket", F.col("doc_id") + 70), "doc_id", 3)
    assert sorted((r["doc_id"], r["_bucket"]) for r in kept.select("doc_id", "_bucket").collect()) == [(1, 71), (2, 72)]
    assert sharding.assign_shards(documents(spark, []), "doc_id", 3).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(rows, "doc_id", 0)


# mixing


def test_mixing_query_equals_sql(spark):
    same_rows(queries.op6_source_mixing(spark, LARGER), run_sql(oracles.OP6, LARGER))


def test_mixing_rules(spark):
    got = queries.op6_source_mixing(spark, LARGER).toPandas()
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "source").toPandas()
    got = got.merge(docs, on="doc_id")
    _, block = source_mixing.block_plan(int(got["size"].sum() * 1.5))
    for _, own in got.groupby("source", dropna=False):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= block
        assert own["target"].iloc[0] <= 2 * own["source_size"].iloc[0]
    assert (got["taken"] <= 2 * got["size"]).all()
    assert abs(got.groupby("source", dropna=False)["target"].first().sum() - 1.5 * got["size"].sum()) < 1


def test_mixing_edge_cases(spark):
    rows = documents(spark, [(1, None, "a"), (2, "", None), (3, "x y", None), (3, "x y", None), (None, "z", "a"), (4, "w " * 500, "b")])
    got = source_mixing.mix(rows.withColumn("src", F.lit(9)).withColumn("size", F.lit("old"))).toPandas()
    assert len(got) == 6 and (got["taken"] <= 2 * got["size"]).all()
    assert source_mixing.mix(documents(spark, [])).count() == 0
    assert source_mixing.mix(documents(spark, [(1, None, "a")])).collect()[0]["taken"] == 0
    kept = source_mixing.mixed_documents(rows)
    assert kept.columns == rows.columns and 0 < kept.count() <= 12


def test_schedule_is_even(spark):
    goals = {0: 500, 1: 200, 2: 300, 3: 0}
    df = spark.createDataFrame(list(goals.items()), "src long, goal long")
    assert source_mixing.block_plan(1000) == (10, 1) and source_mixing.block_plan(1 << 30) == (24, 64)
    got = source_mixing.schedule(df, 7, 10).orderBy("slot").toPandas()
    assert got.groupby("src").size().to_dict() == {0: 50, 1: 20, 2: 30}
    for _, own in got.groupby("src"):
        assert own.sort_values("slot")["rank"].tolist() == list(range(len(own)))
    first = got.head(40).groupby("src").size()
    assert abs(first[0] - 20) <= 3 and abs(first[1] - 8) <= 3
    reverse = {r["slot"]: r["p"] for r in spark.range(128).select(F.col("id").alias("slot"), source_mixing.reversed_bits(F.col("id"), 7).alias("p")).collect()}
    assert reverse == {j: int(f"{j:07b}"[::-1], 2) for j in range(128)}


def test_mixed_documents_stand_in_the_order_of_the_schedule(spark):
    rows = documents(spark, [(k, "w " * (5 + k % 7), "abc"[k % 3]) for k in range(3000)])
    sizes = {r["doc_id"]: r for r in source_mixing.mix(rows).collect()}
    kept = source_mixing.mixed_documents(rows.withColumn("_slot", F.lit(1)).withColumn("_part", F.lit("p")), slots_per_part=512)
    assert {(r["_slot"], r["_part"]) for r in kept.select("_slot", "_part").distinct().collect()} == {(1, "p")}
    by = Counter(r["doc_id"] for r in kept.collect())
    assert by == {k: -(-r["taken"] // r["size"]) for k, r in sizes.items() if r["taken"]}
    early = Counter(r["source"] for r in sizes.values() for _ in range(1) if r["first_slot"] is not None and r["first_slot"] < 6000 for _ in range(r["size"]))
    targets = {r["source"]: r["target"] for r in sizes.values()}
    for source, target in targets.items():
        assert abs(early[source] / sum(early.values()) - target / sum(targets.values())) < 0.05


# near duplicates


def brute_print(text, width=3):
    w = [x for x in re.split(r"[ \t-\r]+", lower(text or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(prints, max_bits=2):
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= max_bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").toPandas()
    prints = {int(i): brute_print(t) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    classes = brute_classes(prints)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash_near_dedup(spark, LARGER).collect()}
    assert got == {i: (f"{p:016x}", classes[i]) for i, p in prints.items()}


@pytest.mark.parametrize("max_bits", [0, 1, 2])
def test_links_of_dense_prints(spark, max_bits):
    rng = random.Random(max_bits)
    base = [rng.getrandbits(64) for _ in range(20)]
    prints = {k: b for k, b in enumerate(base)}
    for k in range(200):
        flipped = rng.choice(base[:3])
        for b in rng.sample(range(64), rng.randrange(0, 5)):
            flipped ^= 1 << b
        prints[100 + k] = flipped
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(k, signed(p)) for k, p in prints.items()], "doc_id long, fp long")
    edges = [(r["u"], r["v"]) for r in simhash_dedup.links(df, max_bits).collect()]
    of = defaultdict(list)
    for k, p in prints.items():
        of[signed(p)].append(k)
    root = {k: k for k in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    def join(a, b):
        x, y = sorted((find(a), find(b)))
        root[y] = x

    for own in of.values():
        for k in own[1:]:
            join(own[0], k)
    for u, v in edges:
        if u in of and v in of:
            join(of[u][0], of[v][0])
    assert {k: find(k) for k in prints} == brute_classes(prints, max_bits)


def test_byte_lists_bound_the_tally():
    shared = lambda differ: sum(not set(q) & set(differ) for q in simhash_dedup.QUADS)
    for k, count in ((0, {14}), (1, {7}), (2, {3}), (3, {1}), (4, {0, 1})):
        assert {shared(d) for d in itertools.combinations(range(8), k)} == count


def test_tally_counts_shared_lists(spark):
    rng = random.Random(9)
    prints = sorted({rng.getrandbits(64) & 0x7F03030303030303 for _ in range(300)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    lists = simhash_dedup.postings(df).groupBy("key").agg(F.collect_list("fp").alias("members"))
    got = {(r["u"], r["v"]): r["shared"] for r in simhash_dedup.tallied(lists, 3).collect()}
    same = lambda u, v: {p for p in range(8) if (u ^ v) >> 8 * p & 255 == 0}
    want = {(u, v): n for u in prints for v in prints if u > v and (n := sum(set(q) <= same(u, v) for q in simhash_dedup.QUADS)) >= 3}
    assert got == want and {p for p in want if len(same(*p)) >= 6} == set(want)


def test_near_duplicates_edge_cases(spark):
    rows = documents(spark, [(1, None, "s"), (2, "", "s"), (3, "A b", "s"), (3, "a B", "s"), (None, "a b", "s"), (9, "zz yy xx ww vv uu " * 20000, "s")])
    got = sorted(map(tuple, simhash_dedup.near_duplicates(rows.withColumn("fp", F.lit("x"))).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, 3), (9, 9)], key=str)
    assert simhash_dedup.near_duplicates(documents(spark, [])).count() == 0
    kept = simhash_dedup.keep_representatives(rows)
    assert kept.columns == rows.columns


def test_one_representative_of_every_class(spark):
    words = [" ".join(f"w{k}x{j}" for j in range(30)) for k in range(5)]
    rows = [
        (1, words[0], "a"), (1, words[0], "b"), (1, words[0], "b"), (2, words[0], "a"),
        (3, words[1], "a"), (5, words[1], "a"), (5, words[2], "a"),
        (None, words[1], "a"), (None, words[3], "a"), (None, words[3], "b"), (None, words[4], "a"),
    ]
    docs = documents(spark, rows)
    kept = simhash_dedup.keep_representatives(docs)
    assert kept.schema == docs.schema
    assert sorted(((r["doc_id"], words.index(r["text"])) for r in kept.collect()), key=str) == sorted(
        [(1, 0), (3, 1), (5, 2), (None, 3), (None, 4)], key=str
    )
    assert simhash_dedup.keep_representatives(documents(spark, [])).count() == 0


# syncmers


def brute_fingerprint(text, k=4):
    unspaced = lambda c: ord(c) >= 0xE00
    units, run = [], ""
    for c in text:
        piece = not unspaced(c) and (ord(c) > 127 or c.isalnum())
        if run and (not piece or len(run) == syncmers.PIECE):
            units.append(run)
            run = ""
        if piece:
            run += c
        elif c not in " \t\n\x0b\x0c\r":
            units.append(c)
    units += [run] if run else []
    h = lambda x: hashlib.md5(" ".join(x).encode()).hexdigest()[:7]
    runs = [units[i : i + k] for i in range(len(units) - k + 1)]
    chosen = {h(r) for r in runs if min(r) in (r[0], r[-1])}
    return ",".join(sorted(chosen or ({h(units)} if units else set())))


def test_syncmer_query_equals_sql(spark):
    same_rows(queries.op7_syncmer_fingerprints(spark, SMALL), run_sql(oracles.OP7, SMALL))


def test_syncmer_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").toPandas()
    texts = [t or "" for t in docs["text"]]
    got = {r["doc_id"]: r for r in queries.op7_syncmer_fingerprints(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for k, (i, t) in enumerate(zip(docs["doc_id"], texts, strict=True)):
        nxt = texts[(k + 1) % len(texts)]
        q = len(t) // 4
        edited = t[: len(t) - q] + nxt[:q]
        r = got[i]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == brute_fingerprint(t)
        assert r["edited_fingerprint"] == brute_fingerprint(edited)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


def test_syncmer_next_over_many_ranges(spark):
    rows = spark.range(5000).select((F.col("id") * 7 % 5003).alias("doc_id"), F.col("id").cast("string").alias("text"))
    dealt, order = syncmers.in_ranges(rows, "doc_id", F.col("text"), rows_per_bucket=300)
    got = dealt.withColumn("next", F.lead("text").over(order)).where("_extra = 0").toPandas().sort_values("doc_id")
    assert len(got) == 5000
    texts = got["text"].tolist()
    assert got["next"].tolist() == texts[1:] + texts[:1]


def test_syncmer_fingerprints_of_odd_texts(spark):
    rng = random.Random(6)
    chars = ["a", "b", "Z", "9", " ", "\t", "\x0b", "\x1f", "é", "中", "文", "か", "ก", "_", "-", "\u00a0", "😀", "𠀀"]
    texts = ["".join(rng.choices(chars, k=rng.randrange(0, 60))) for _ in range(300)] + ["中文" * 700, "ab" * 30000, "x y " * 20000]
    rows = documents(spark, [(k, t, "s") for k, t in enumerate(texts)])
    got = {r["doc_id"]: r["p"] for r in syncmers.fingerprint(rows, "text", "fp").select("doc_id", syncmers.print_text("fp").alias("p")).collect()}
    assert got == {k: brute_fingerprint(t) for k, t in enumerate(texts)}


def test_syncmers_tell_edited_texts_from_others(spark):
    got = queries.op7_syncmer_fingerprints(spark, LARGER).toPandas()
    long = got[got["n_chars"] >= 40]
    assert (long["near_edited"] > 0.3).mean() > 0.97 and (got["near_edited"] >= got["near_next"]).mean() > 0.97
    assert long["near_edited"].median() > 0.5 and got["near_next"].median() < 0.2


def test_syncmer_edge_cases(spark):
    rows = documents(spark, [(1, None, "s"), (None, "", "s"), (2, "abc", "s"), (2, "abc", "s"), (3, "\U0001f600" * 9, "s")])
    got = syncmers.fingerprints(rows.withColumn("fp", F.lit(1)))
    assert got.count() == 5
    assert syncmers.fingerprints(documents(spark, [])).count() == 0
    one = syncmers.fingerprints(documents(spark, [(1, "abcdefgh", "s")])).collect()[0]
    assert one["edited"] == "abcdefab"


def test_cut_number(spark):
    rng = random.Random(8)
    for n in (0, 1, 2, 7, 100):
        cuts = sorted(rng.sample(range(-1000, 1000), n))
        got = spark.range(-1005, 1005).select("id", syncmers.cut_number(F.col("id"), cuts).alias("n")).collect()
        assert [r["n"] for r in got] == [sum(c <= r["id"] for c in cuts) for r in got]


# secrets


def brute_base(text):
    assign = re.compile(r"""(?a:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.I)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_secrets_equal_brute_force(spark):
    rng = random.Random(3)
    bits = ["password", "Secret=", "API_KEY: ", "token", "=", ": ", "'", '"', "AKIA", "ABCD1234EFGH", "0f" * 17, "deadbeef", " ", "é", "passw", "abcdefgh", "Zz9+/" * 6]
    rows = [(k, "".join(rng.choices(bits, k=rng.randrange(0, 25))), "abc"[k % 3]) for k in range(400)]
    rows += [(1000, None, None), (1001, "", "a"), (1001, "password=12345678", "a")]
    got = secret_scan.secrets(documents(spark, rows)).collect()
    want = Counter((i, tuple((k, s, e) for s, _, k, e in brute_base(t or ""))) for i, t, _ in rows)
    have = Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "token")) for r in got)
    assert have == want


def test_secret_query_on_the_small_table(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").toPandas()
    got = {r["doc_id"]: r for r in queries.op9_secret_ownership(spark, LARGER).collect()}
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        base = brute_base(t or "")
        listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in base)
        assert got[i]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        counts = Counter(k for _, _, k, _ in base)
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == (counts["assign"], counts["access"], counts["hex"])


def test_secret_ownership(spark):
    own, common = "password=own12345", "password=common123"
    rows = [(1, own, "a"), (2, own, "a"), (3, common, "a"), (4, common, "b"), (5, common, "c"), (6, "nothing", "d")]
    got = {r["doc_id"]: [s["verdict"] for s in r["spans"]] for r in secret_scan.secrets(documents(spark, rows)).collect()}
    assert got == {1: ["live"], 2: ["live"], 3: ["example"], 4: ["example"], 5: ["example"], 6: []}
    assert secret_scan.secrets(documents(spark, [])).count() == 0


def test_secrets_that_most_documents_hold(spark):
    own = "Zq7" + "aB3x" * 8
    rows = [(k, f"x {own}{k} password=common123" + (" y" * 100_000 if k == 3 else ""), "abc"[k % 3]) for k in range(60)]
    docs = documents(spark, rows).withColumn("spans", F.lit(1)).withColumn("value", F.lit("v")).withColumn("_row", F.lit(0)).withColumn("n_docs", F.lit(9))
    whole = secret_scan.secrets(docs).collect()
    assert {tuple((s["kind"], s["verdict"]) for s in r["spans"]) for r in whole} == {(("token", "live"), ("assign", "example"))}
    assert len(whole) == 60


def test_canonical_orders_rows():
    import pandas as pd

    assert canonical(pd.DataFrame({"b": [2.0, None], "a": [1, 0]})) == [(0, None), (1, 2.0)]
