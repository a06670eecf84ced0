"""Commits, proposals, renames, reconciliation, pairs, signals, taxonomies, chunks, vectors and paths against plain passes."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import time
from collections import Counter, defaultdict

import pandas as pd
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from folio.operators import chunks, embedding, linkage, matching, normalise, pathfit, proposals, reconcile, sinks, taxonomy
from folio.plans import lineage, proposal_queries, upkeep_queries
from folio.plans.catalogue import QUERIES
from folio.plans.lineage import store
from folio.plans.sizes import hashed, spread
from folio.sources.commits import Change, CommitConflict, Tables
from folio.streaming import renames

# commits


def folder(spark):
    return upkeep_queries.folder_for_tests(spark)


def test_a_commit_is_seen_whole_or_not_at_all(spark):
    tables = Tables(spark, folder(spark))
    rows = lambda *xs: spark.createDataFrame(xs, "k long, v string")
    assert tables.versions() == [] and tables.manifest()["tables"] == {}
    assert tables.commit({"a": Change(rows((1, "x"), (2, "y")), ("k",), 4), "b": Change(rows((9, "z")))}) == 1

    def stop(name):
        if name == "a":
            raise RuntimeError("between two tables")

    with pytest.raises(RuntimeError):
        tables.commit({"a": Change(rows((1, "other"))), "b": Change(rows((9, "other")))}, before_manifest=stop)
    assert sorted(map(tuple, tables.read("a").collect())) == [(1, "x"), (2, "y")]
    assert [tuple(r) for r in tables.read("b").collect()] == [(9, "z")]
    with pytest.raises(CommitConflict):
        tables.commit({"b": Change(rows((9, "late")))}, base=0)
    assert tables.commit({"b": Change(rows((9, "late")))}, base=1) == 2
    assert [tuple(r) for r in tables.read("b", 1).collect()] == [(9, "z")]
    assert tables.vacuum() >= 2  # what the stopped writer and version 1 left
    assert tables.versions() == [2] and tables.read("a").count() == 2
    with pytest.raises(ValueError):
        tables.read("b", 1)


def test_two_writers_of_one_version(spark):
    """The manifest's name decides: the second writer's files stay out of sight."""
    path = folder(spark)
    rows = spark.createDataFrame([(1,)], "k long")
    first, second = Tables(spark, path), Tables(spark, path)
    with pytest.raises(CommitConflict):
        second.commit({"t": Change(rows)}, before_manifest=lambda name: first.commit({"t": Change(rows.union(rows))}))
    assert first.versions() == [1] and first.read("t").count() == 2


def test_only_touched_parts_are_written(spark):
    tables = Tables(spark, folder(spark))
    tables.commit({"t": Change(spark.range(100).select(F.col("id").alias("k"), F.lit(0).alias("v")), ("k",), 8)})
    changed = spark.createDataFrame([(5,)], "k long")
    parts = tables.parts_of("t", changed)
    assert len(parts) == 1
    before = tables.manifest()["tables"]["t"]["parts"]
    new = tables.read("t", parts=parts).withColumn("v", F.when(F.col("k") == 5, 1).otherwise(F.col("v")))
    tables.commit({"t": Change(new, touched=parts), "log": Change(changed, append=True)})
    tables.commit({"log": Change(changed, append=True)})
    after = tables.manifest()["tables"]["t"]["parts"]
    assert [p for p in before if before[p] != after[p]] == [str(parts[0])]
    assert tables.read("t").agg(F.sum("v"), F.count("*")).first()[:] == (1, 100)
    assert tables.read("log").count() == 2
    tables.commit({"t": Change(new.limit(0), touched=parts)})
    assert tables.read("t").count() == 100 - tables.read("t", 3, parts=parts).count()


def test_scan_reviews_follow_what_is_found(spark):
    before = spark.createDataFrame([("f", "scan", "unreadable", "open", 1), ("g", "scan", "unreadable", "ignored", 2), ("h", "scan", "unreadable", "open", 1), ("f", "analysis", "unreadable", "open", 1)], sinks.REVIEWS)
    found = spark.createDataFrame([("g", "unreadable"), ("n", "unreadable")], "file string, reason string")
    seen = spark.createDataFrame([("f",), ("g",), ("n",)], "file string")
    got = {tuple(r) for r in sinks.reviewed(before, found, seen, "scan").collect()}
    assert got == {("f", "scan", "unreadable", "resolved", 1), ("g", "scan", "unreadable", "ignored", 3), ("h", "scan", "unreadable", "open", 1), ("n", "scan", "unreadable", "open", 1), ("f", "analysis", "unreadable", "open", 1)}


def test_a_second_scan_moves_a_file_to_another_content(spark):
    tables = Tables(spark, folder(spark))
    scan = "file string, path string, byte_size long, digest string, at long, readable boolean, error string"
    issues = spark.createDataFrame([], "path string, code string")
    sinks.commit_scan(tables, 1, spark.createDataFrame([("a", "a.txt", 1, "x", 1, True, None), ("b", "b.txt", 1, "x", 1, True, None), ("c", "c.txt", 2, "y", 1, True, None)], scan), issues)
    sinks.commit_scan(tables, 2, spark.createDataFrame([("b", "b.txt", 2, "y", 5, True, None)], scan), issues)
    assert [tuple(r) for r in tables.read("duplicates").collect()] == [("y", 2, "b.txt")]
    held = {(r["file"], r["version"], r["valid_to"]) for r in tables.read("versions").collect()}
    assert held == {("a", 1, None), ("b", 1, 5), ("b", 2, None), ("c", 1, None)}


# proposals


def plain_inputs(spark, rows):
    kinds = (
        "file_id long, path string, name string, context string, context_confidence double, document_type string, type_confidence double, customer string, supplier string, project string, "
        "relation_confidence double, date string, identifier string, quality double, semantic_status string, extraction_status string, review_reasons string, duplicate boolean, rule string, rule_destination array<string>, "
        "rule_years boolean, override string, override_destination array<string>, override_name string"
    )
    names = [k.split()[0] for k in kinds.split(", ")]
    base = {"context": "business", "context_confidence": 0.95, "type_confidence": 0.95, "quality": 0.95, "semantic_status": "success", "extraction_status": "success", "review_reasons": "", "duplicate": False, "relation_confidence": 0.95}
    return spark.createDataFrame([tuple({**base, **r}.get(n) for n in names) for r in rows], kinds)


def random_file(rng, i):
    name = rng.choice(["a.pdf", "A.PDF", "a_2.pdf", "a_2_2.pdf", "a_3.pdf", "b", "b_2", f"c{i}.txt"])
    return {
        "file_id": i, "path": f"in/{name}", "name": name, "document_type": rng.choice(["invoice", "quote", "photo", "contract", None]), "customer": rng.choice([None, "Ann", "ann", "Bob"]),
        "supplier": rng.choice([None, "Sup"]), "project": rng.choice([None, None, "P"]), "date": rng.choice([None, "2020-01-01", "2021-05-05"]), "override": rng.choice([None] * 9 + ["rename"]), "override_name": "a.pdf",
        "relation_confidence": rng.choice([0.95, 0.1]),
    }


def shown(df):
    return {r["file_id"]: (tuple(r["destination"]), r["new_name"], r["kind"], r["conflict"], r["needs_review"], tuple(r["reasons"])) for r in df.collect()}


def brute_settled(drafts, least):
    """The sequential passes: folders lose optional ends until nothing changes, then names are numbered in order."""
    rows = [dict(r.asDict(), destination=list(r["destination"]), optional=list(r["optional"])) for r in drafts.orderBy("file_id").collect()]
    changed = True
    while changed and least > 1:
        counts = Counter("\\".join(x.lower() for x in r["destination"][:n]) for r in rows for n in range(1, len(r["destination"]) + 1))
        changed = False
        for r in rows:
            if r["optional"] and r["optional"][-1] and counts["\\".join(x.lower() for x in r["destination"])] < least:
                r["destination"], r["optional"], changed = r["destination"][:-1], r["optional"][:-1], True
    seen = {}
    out = {}
    for r in rows:
        name, conflict, kind = r["new_name"], r["conflict"], r["kind"]
        key = lambda n: "\\".join([*r["destination"], n]).lower()  # noqa: B023, E731
        if kind not in ("keep_in_place", "no_action"):
            seen[key(name)] = ordinal = seen.get(key(name), 0) + 1
            if ordinal > 1 and r["overridden"]:
                conflict, kind = "destination_collision", "to_review"
            elif ordinal > 1:
                stem, dot, ending = name.rpartition(".") if re.fullmatch(r".+\.[^.]{1,16}", name) else (name, "", "")
                while key(f"{stem}_{ordinal}{dot}{ending}") in seen:
                    ordinal += 1
                name, conflict = f"{stem}_{ordinal}{dot}{ending}", "auto_resolved"
                seen[key(name)] = 1
        out[r["file_id"]] = (tuple(r["destination"]), name, kind, conflict)
    return out


def test_proposals_equal_the_sequential_passes_and_increments_the_whole(spark):
    rng = random.Random(1)
    p = proposals.Preferences(least_group=3)
    files = [random_file(rng, i) for i in range(70)]
    drafts = store(proposals.compiled(plain_inputs(spark, files), p), "drafts")
    before = store(proposals.settled(proposals.grouped(drafts, p.least_group)), "proposal")
    assert {k: v[:4] for k, v in shown(before).items()} == brute_settled(drafts, p.least_group)
    dirty = {rng.randrange(90): None for _ in range(8)}
    gone = [i for i in rng.sample(range(70), 4) if i not in dirty]
    changed = [random_file(rng, i) for i in dirty]
    after = [f for f in files if f["file_id"] not in dirty and f["file_id"] not in gone] + changed
    deleted = spark.createDataFrame([(i,) for i in gone], "file_id long")
    fresh, now, affected = proposals.incremental(drafts, before, plain_inputs(spark, changed), deleted, p)
    assert shown(now) == shown(proposals.build(plain_inputs(spark, after), p))
    assert shown(fresh).keys() == {f["file_id"] for f in after}
    touched = {r["file_id"] for r in affected.collect()}
    old, new = shown(before), shown(now)
    assert {i for i in new if new[i] != old.get(i)} <= touched


def test_why_a_proposal_is_built_whole(spark):
    ids = lambda n: spark.range(n).select(F.col("id").alias("file_id"))
    reason = proposals.rebuild_reason
    assert reason(ids(3), ids(1), ids(0), True) == "preferences_or_rules_changed" and reason(ids(0), ids(1), ids(0)) == "no_previous_proposal"
    assert reason(ids(3), ids(0), ids(0)) == "empty_dirty_set" and reason(ids(3), ids(9), ids(2), most=8) == "dirty_set_too_large:>8"
    assert reason(ids(3), ids(2), ids(3)) is None


def test_destinations_follow_the_policy(spark):
    files = [
        {"file_id": 1, "path": "x/scan.pdf", "name": "scan.pdf", "document_type": "invoice", "customer": "Ann", "date": "2020-02-02", "identifier": "N1"},
        {"file_id": 2, "path": "x/tt.pdf", "name": "tt.pdf", "context": "personal", "document_type": "tax_document", "date": "2020-02-02"},
        {"file_id": 3, "path": "x/uu.pdf", "name": "uu.pdf", "context": "mixed", "document_type": "quote"},
        {"file_id": 4, "path": "x/vv.jpg", "name": "vv.jpg", "document_type": "photo", "customer": "Ann", "project": "House"},
        {"file_id": 5, "path": "x/w.pdf", "name": "w.pdf", "document_type": "invoice", "rule": "destination", "rule_destination": ["Mine", "There"]},
        {"file_id": 6, "path": "x/w.pdf", "name": "w.pdf", "document_type": "invoice", "rule": "destination", "rule_destination": ["..", "There"]},
        {"file_id": 7, "path": "Business/Clients/Ann/kk.pdf", "name": "kk.pdf", "document_type": "quote", "customer": "Ann"},
        {"file_id": 8, "path": "x/y.pdf", "name": "y.pdf", "document_type": "cv", "override": "destination", "override_destination": ["C:"]},
        {"file_id": 9, "path": "x/z.pdf", "name": "z.pdf", "document_type": "cv", "duplicate": True},
        {"file_id": 10, "path": "x/q.pdf", "name": "q.pdf", "document_type": "cv", "context_confidence": 0.3, "type_confidence": 0.2, "relation_confidence": None},
    ]
    got = {r["file_id"]: ("/".join(r["destination"]), r["new_name"], r["kind"]) for r in proposals.compiled(plain_inputs(spark, files)).collect()}
    assert got == {
        1: ("Business/Clients/Ann/2020/Invoices", "2020-02-02_Ann_Invoice_N1.pdf", "move"), 2: ("Personal/Administrative/Taxes/2020", "tt.pdf", "move"), 3: ("TO_REVIEW", "uu.pdf", "to_review"),
        4: ("Business/Projects/House/Photos", "vv.jpg", "move"), 5: ("Mine/There", "w.pdf", "move"), 6: ("TO_REVIEW", "w.pdf", "to_review"), 7: ("Business/Clients/Ann", "kk.pdf", "keep_in_place"),
        8: ("C:", "y.pdf", "move"), 9: ("Business/HR", "z.pdf", "no_action"), 10: ("TO_REVIEW", "q.pdf", "to_review"),
    }


# renames

HINTS = "root long, native string, path_before string, path_after string, kind string, scope string, at_ms long, seq long"


def sequential(hints, ttl):
    out, waiting = [], {}
    for h in sorted(hints, key=lambda h: (h[6], h[7])):
        root, native, before, after, kind, scope, at, seq = h
        if not (kind == "moved" and (before is None) != (after is None)):
            out.append((root, native, before, after, kind, scope, seq))
            continue
        if native is None:
            out.append((root, native, before, after, "rescan", "unknown", seq))
            continue
        last = waiting.pop((root, native), None)
        if last and (last[2] is None) != (before is None) and at - last[6] <= ttl:
            merged = scope if scope == last[5] else last[5] if scope == "unknown" else scope if last[5] == "unknown" else "unknown"
            out.append((root, native, before or last[2], after or last[3], "moved", merged, seq))
            continue
        if last:
            out.append((*last[:4], "rescan", "unknown", last[7]))
        waiting[root, native] = h
    return sorted([*out, *((*h[:4], "rescan", "unknown", h[7]) for h in waiting.values())], key=str)


def random_hints(rng, n):
    out = []
    for seq in range(n):
        side = rng.choice(["before", "after", "both"])
        native = rng.choice(["n1", "n2", "n3", None])
        out.append((rng.randrange(2), native, None if side == "after" else f"b{seq}", None if side == "before" else f"a{seq}", rng.choice(["moved", "moved", "modified"]), rng.choice(["file", "folder", "unknown"]), 1000 + 40 * seq + rng.randrange(60), seq))
    return out


def test_paired_renames_equal_the_sequential_pass(spark):
    hints = random_hints(random.Random(2), 160)
    got = renames.paired(spark.createDataFrame(hints, HINTS), 100).drop("at_ms")
    assert sorted(map(tuple, got.collect()), key=str) == sequential(hints, 100)


def test_the_stream_of_renames_equals_the_batch(spark, tmp_path):
    """Halves come in several files and out of order, some partners come too late; timers let the others go."""
    rng = random.Random(4)
    hints = random_hints(rng, 90)
    end = (9, "end", None, None, "modified", "file", 10**6, 10**6)  # moves the watermark past all others
    rng.shuffle(hints)
    (tmp_path / "in").mkdir()
    for n, part in enumerate([sorted(hints, key=lambda h: h[6])[:45], sorted(hints, key=lambda h: h[6])[45:], [end], [(*end[:6], end[6] + 1, end[7] + 1)]]):
        rng.shuffle(part)
        rows = [dict(zip([c.split()[0] for c in HINTS.split(", ")], h, strict=True), ts=h[6] / 1000) for h in part]
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
    read = spark.readStream.schema(f"{HINTS}, ts double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    stream = renames.paired_stream(read.withColumn("ts", F.timestamp_millis("at_ms")), 100, "5 seconds")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("root <> 9").drop("at_ms")
    assert sorted(map(tuple, got.collect()), key=str) == sequential(hints, 100)


def test_roots_that_a_move_crosses(spark):
    moves = spark.createDataFrame([(1, "n", "/r/a/x", "/r/b/x", "file", 5), (2, "n", "/r/a/x", "/out/x", "file", 6), (3, "n", "/out/x", "/out/y", "file", 7), (4, "n", "/r/b/x", "/r/b/y", "file", 8)], "seq long, native string, before string, after string, scope string, at_ms long")
    roots = spark.createDataFrame([(1, "/r"), (2, "/r/a"), (3, "/r/b")], "root long, folder string")
    got = {(r["seq"], r["root"], r["path_before"], r["path_after"], r["kind"]) for r in renames.crossing(moves, roots).collect()}
    assert got == {(1, 1, "a/x", "b/x", "moved"), (1, 2, "x", None, "removed"), (1, 3, None, "x", "created"), (2, 1, "a/x", None, "removed"), (2, 2, "x", None, "removed"), (4, 1, "b/x", "b/y", "moved"), (4, 3, "x", "y", "moved")}


def test_coalesced_hints(spark):
    rows = [
        (1, "n", "p", None, "moved", "file", 1, 1), (1, "n", None, "q", "moved", "unknown", 2, 2), (1, None, None, "z", "created", "file", 3, 3), (1, None, None, "z", "removed", "folder", 4, 4),
        (2, None, None, "z", "created", "file", 1, 5), (2, None, None, None, "rescan", "unknown", 2, 6),
    ]
    got = {tuple(r) for r in renames.coalesced_hints(spark.createDataFrame(rows, HINTS)).collect()}
    assert got == {(1, "n", "p", "q", 1, "moved", "file"), (1, None, None, "z", 2, "removed", "unknown"), (2, None, None, None, 1, "rescan", "unknown")}


# reconciliation

ENTRY = "root long, path string, byte_size long, modified_ms long"


def test_absence_is_only_proven_by_complete_sides(spark):
    listing = spark.createDataFrame([(1, "A/x", 1, 1), (1, "n", 1, 1), (2, "n", 1, 1), (3, "same", 1, 1), (4, "n", 1, 1)], ENTRY)
    catalog = spark.createDataFrame([(1, "a/X", 2, 1), (1, "gone", 1, 1), (2, "gone", 1, 1), (3, "same", 1, 1), (4, "g", 1, 1), (4, "h", 1, 1)], ENTRY)
    roots = spark.createDataFrame([(1, True, True, 10), (2, True, False, 10), (3, True, True, 10), (4, True, True, 2), (5, False, True, 9)], "root long, enabled boolean, complete boolean, entry_limit long")
    events, states = reconcile.startup(listing, catalog, roots)
    assert {tuple(r) for r in events.collect()} == {(1, None, "A/x", "modified"), (1, None, "n", "created"), (1, "gone", None, "removed"), (2, None, "n", "created"), (4, None, "n", "created")}
    assert {(r["root"], r["state"]) for r in states.collect()} == {(1, "reconciling"), (2, "deferred"), (3, "reconciled"), (4, "deferred"), (5, "skipped")}


def test_directories_nest_and_exclusions_hold(spark):
    listing = spark.createDataFrame([(1, "a/x", 1, 1), (1, "a/b/y", 1, 1), (1, "ab/z", 1, 1), (1, "c", 1, 1), (1, "a/skip/q", 1, 1)], ENTRY)
    catalog = spark.createDataFrame([(1, "a/b/old", 1, 1), (1, "ab/old", 1, 1), (1, "a/skip/q", 2, 2), (1, "d/was", 1, 1)], ENTRY)
    changes = spark.createDataFrame([(1, "a", "a", True), (1, None, "a/b", True), (1, "ab", "ab", False), (1, "d", "a/b", True)], "root long, folder_before string, folder_after string, complete boolean")
    skip = spark.createDataFrame([(None, "A/SKIP")], "root long, folder string")
    events, states = reconcile.directory_gaps(listing, catalog, changes, skip)
    assert sorted(map(str, (tuple(r) for r in events.collect()))) == sorted(map(str, [(1, None, "a/x", "created"), (1, None, "a/b/y", "created"), (1, "a/b/old", None, "removed"), (1, "d/was", None, "removed")]))
    assert sorted(r["state"] for r in states.collect()) == ["overflowed", "reconciling", "reconciling", "reconciling"]
    whole = spark.createDataFrame([(1, None, None, True)], changes.schema)
    assert {r["kind"] for r in reconcile.directory_gaps(listing, catalog, whole)[0].where("path_after = 'c' or path_before = 'ab/old'").collect()} == {"created", "removed"}


# pairs, signals, candidates


def brute_capped(pairs, most):
    held, out = Counter(), set()
    for p in sorted(pairs, key=lambda p: (*p[2:], p[0], p[1])):
        if held[p[0]] < most and held[p[1]] < most:
            held[p[0]] += 1
            held[p[1]] += 1
            out.add(p)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_capped_pairs_equal_the_sequential_pass(spark, seed):
    rng = random.Random(seed)
    pairs = list({(min(a, b), max(a, b)): (f"m{min(a, b)}", f"m{max(a, b)}", rng.randrange(3), rng.randrange(4)) for a, b in ((rng.randrange(25) if rng.random() < 0.6 else 0, rng.randrange(25)) for _ in range(180)) if a != b}.values())
    df = spark.createDataFrame(pairs, "a string, b string, priority int, gap int")
    assert {tuple(r) for r in matching.capped(df, ["priority", "gap"], 2 + seed).collect()} == brute_capped(pairs, 2 + seed)
    assert matching.capped(df.limit(0), ["priority", "gap"]).count() == 0


@pytest.mark.parametrize("group", [5, 40])
def test_capped_pairs_of_classes_beyond_one_task(spark, group):
    rng = random.Random(group)
    pairs = list({(a, b): (a, b, rng.randrange(3), rng.randrange(4)) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(300)) if a < b}.values())
    df = spark.createDataFrame(pairs, "a int, b int, priority int, gap int")
    assert {tuple(r) for r in matching.capped(df, ["priority", "gap"], 3, group=group).collect()} == brute_capped(pairs, 3)


def test_a_chain_of_pairs_takes_few_rounds(spark, monkeypatch):
    stored = []
    monkeypatch.setattr(matching, "store", lambda df, name, store=matching.store: stored.append(name) or store(df, name))
    pairs = [(i, i + 1, 0) for i in range(100, 160)]
    got = {tuple(r) for r in matching.capped(spark.createDataFrame(pairs, "a int, b int, gap int"), ["gap"], 1).collect()}
    assert got == brute_capped(pairs, 1) and len(stored) < 10


def test_classes_of_pairs_come_from_two_edges_a_mention(spark, monkeypatch):
    """Whatever pairs a class has, and where one mention ties two crowds together."""
    edges = []
    monkeypatch.setattr(matching, "components", lambda df, components=matching.components: edges.append(df.count()) or components(df))
    crowd = lambda ids: [(a, b, 0) for a in ids for b in ids if a < b]
    pairs = crowd(range(30)) + crowd(range(29, 60)) + crowd(range(100, 110))
    rows = spark.createDataFrame(pairs, "a int, b int, gap int")
    roots = {r["node"]: (r["root"], r["degree"]) for r in matching._classes(rows, "a", "b").collect()}
    h = {r["m"]: r["h"] for r in spark.createDataFrame([(i,) for i in {*range(60), *range(100, 110)}], "m int").select("m", F.xxhash64("m").alias("h")).collect()}
    assert len({roots[h[m]][0] for m in range(60)}) == 1 and len({roots[h[m]][0] for m in range(100, 110)}) == 1 and len({r for r, _ in roots.values()}) == 2
    assert roots[h[0]][1] == 29 and roots[h[29]][1] == 59 and sum(edges) <= 2 * 70 + 8 < len(pairs)
    assert {tuple(r) for r in matching.capped(rows, ["gap"], 4).collect()} == brute_capped(pairs, 4)


def test_capped_query(spark):
    pairs = [tuple(r) for r in upkeep_queries._ranked(spark, SMALL).select("a", "b", "priority", "blocks").collect()]
    got = {(r["a"], r["b"], r["priority"], r["blocks"]) for r in QUERIES["identity_capped"](spark, SMALL).collect()}
    assert got == brute_capped(pairs, 4) and len(got) < len(pairs)


def test_signals_go_to_the_nearest_alone(spark):
    sources = [(1, "a", "organization", 100), (1, "b", "organization", 300), (1, "c", "project", 310), (2, "d", "person", None), (3, "e", "person", 5), (3, "f", "person", 5), (4, "g", "organization", 0), (4, "h", "organization", 5000), (5, "i", "project", 7)]
    signals = [
        (1, "s1", "email", 120), (1, "s2", "email", 200), (1, "s3", "email", 299), (1, "s4", "project_reference", 9999), (2, "s5", "phone", None), (3, "s6", "email", 6), (4, "s7", "email", 400), (4, "s8", "email", 2000), (4, "s9", "email", None),
        (5, "s10", "email", 7), (6, "s11", "email", 1), (1, "s12", "email", 100),
    ]
    got = matching.attached(spark.createDataFrame(sources, "doc long, source_id string, kind string, start long"), spark.createDataFrame(signals, "doc long, signal_id string, signal string, start long"), "doc")
    assert {(r["signal_id"], r["source_id"]) for r in got.collect()} == {("s1", "a"), ("s3", "b"), ("s4", "c"), ("s5", "d"), ("s7", "g"), ("s12", "a")}


def test_candidates_retire_for_each_reason(spark):
    rows = [
        (1, "a", "b", "candidate", True, "v2", "g1"), (2, "a", "c", "candidate", True, "v2", "g1"), (3, "a", "d", "conflicting", True, "v1", "g2"), (4, "a", "dead", "candidate", True, "v2", "g2"), (5, "c", "d", "user_confirmed", True, "v1", "g3"),
        (6, "a", "nobody", "candidate", True, None, "g3"), (7, "c", "a", "candidate", False, "v1", "g4"), (8, "c", "d", "auto_linked", True, "v1", "g4"),
    ]
    candidates = spark.createDataFrame(rows, "candidate long, a string, b string, status string, active boolean, version string, review_group string")
    occurrences = spark.createDataFrame([("a", True), ("b", True), ("c", True), ("d", True), ("d", False), ("dead", False)], "identity string, active boolean")
    out = matching.superseded(candidates, occurrences, spark.createDataFrame([("c",), ("c",)], "identity string"), "v2")
    assert {(r["candidate"], r["status"], r["active"], r["retired_for"]) for r in out.collect()} == {
        (1, "candidate", True, None), (2, "superseded", False, "changed"), (3, "superseded", False, "outdated"), (4, "superseded", False, "orphaned"), (5, "user_confirmed", True, None), (6, "superseded", False, "outdated"),
        (7, "candidate", False, None), (8, "auto_linked", True, None),
    }
    assert {tuple(r) for r in matching.refreshed_groups(out).collect()} == {("g1", 1, "open"), ("g2", 0, "resolved"), ("g3", 0, "resolved"), ("g4", 0, "resolved")}
    found = spark.createDataFrame([(1, "a", "b", "conflicting", True, "v3", "g1"), (5, "c", "d", "candidate", True, "v3", "g3"), (9, "x", "y", "candidate", True, "v3", "g9")], candidates.schema)
    merged = {(r["candidate"], r["status"], r["version"]) for r in matching.merged_candidates(candidates, found, ["candidate", "a", "b"], ["version"]).collect()}
    assert {(1, "conflicting", "v3"), (5, "user_confirmed", "v1"), (9, "candidate", "v3")} <= merged and len(merged) == 9


def test_merges_are_followed_to_their_end(spark):
    merges = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "c"), ("q", "p"), ("r", "p"), ("y", "x"), ("x", "y")], "kept string, other string")
    assert {(r["other"], r["kept"]) for r in linkage.merge_ends(merges).collect()} == {("a", "d"), ("b", "d"), ("c", "d"), ("p", "q"), ("y", "x")}


# taxonomies


def test_cycles_of_a_deep_taxonomy(spark, monkeypatch):
    rounds = []
    real = taxonomy._hanging
    monkeypatch.setattr(taxonomy, "_hanging", lambda edges: rounds.append(1) or real(edges))
    chain = [(i, i + 1) for i in range(1000, 1600)]
    rings = [(1, 2), (2, 3), (3, 1), (3, 10), (10, 11), (11, 20), (20, 21), (21, 20), (21, 99), (50, 1), (7, 7), (7, 8), (None, 5), (5, None), (1, 2)]
    got = taxonomy.cyclic(spark.createDataFrame(chain + rings, "parent long, child long"))
    assert sorted(map(tuple, got.collect())) == [(1, 2), (2, 3), (3, 1), (3, 10), (7, 7), (10, 11), (11, 20), (20, 21), (21, 20)]
    assert len(rounds) <= 4
    assert taxonomy.cyclic(spark.createDataFrame(chain, "parent long, child long")).count() == 0
    assert taxonomy.cyclic(spark.createDataFrame([], "parent long, child long")).count() == 0
    nodes = spark.createDataFrame([(1,), (2,)], "code long")
    assert [r[0] for r in taxonomy.unknown_codes(nodes, spark.createDataFrame([(1, 2), (2, 4)], "parent long, child long")).collect()] == [4]


# chunks, vectors, paths


def test_structured_chunks_point_into_the_text(spark):
    texts = {
        1: "first page\n\f\f  third page \n", 2: "head\nSheet: One\nalpha\nbeta\n\nSLIDE 2\n\ngamma", 3: "para one\n\npara two\n\n\n\npara three", 4: "  only one  ", 5: None, 6: " \n ", 7: "word " * 9000, 8: "Sheet\nnext line",
    }
    docs = spark.createDataFrame([(i, t, f"filename: {i}" if i != 4 else None) for i, t in texts.items()], "id long, t string, m string")
    rows = chunks.structured_chunks(docs, "id", "t", "m").collect()
    got = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["id"], r["chunk"])):
        if r["kind"] == "text_chunk":
            assert texts[r["id"]][r["start_char"] : r["end_char"]].strip() == r["text"]
        got[r["id"]].append((r["chunk"], r["text"], r["page"], r["part"], r["truncated"]))
    assert got[1] == [(0, "filename: 1", None, None, False), (1, "first page", 1, None, False), (2, "third page", 3, None, False)]
    assert got[2][1:] == [(1, "head", None, None, False), (2, "alpha\nbeta", None, "One", False), (3, "gamma", None, "2", False)]
    assert [c[1] for c in got[3][1:]] == ["para one", "para two", "para three"]
    assert got[4] == [(1, "only one", None, None, False)]
    assert [c[1] for c in got[5]] == ["filename: 5"] and len(got[6]) == 1
    assert len(got[7]) == 17 and all(c[4] for c in got[7])
    assert got[8][1:] == [(1, "Sheet\nnext line", None, None, False)]


def plain_vector(text, dimensions=256):
    words = [w for w in re.findall(r"[^\W_]+", (text or "").lower()) if len(w) >= 2]
    words += [x for w, others in embedding.CONCEPTS.items() if w in words for x in others]
    out = [0.0] * dimensions

    def add(feature, weight):
        h = hashlib.md5(feature.encode()).hexdigest()
        out[int(h[:4], 16) % dimensions] += weight if int(h[4:6], 16) % 2 == 0 else -weight

    for w in words:
        add(w, 1.0)
        for i in range(len(w) - 2):
            add(w[i : i + 3], 0.35)
    for a, b in zip(words, words[1:], strict=False):
        add(f"{a}:{b}", 0.55)
    n = math.sqrt(sum(x * x for x in out))
    return [x / n for x in out] if n > 1e-9 else None


def test_development_search_equals_all_cosines(spark):
    texts = ["facture client 12", "devis chantier nord", "photo ab", "client invoice customer", "", None, "xy", "projet nord nord"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    vectors = embedding.development(docs, "id", "t")
    dense = defaultdict(dict)
    for r in vectors.collect():
        dense[r["id"]][r["bucket"]] = r["weight"]
    for i, t in enumerate(texts):
        v = plain_vector(t)
        assert {b: round(x, 9) for b, x in enumerate(v or []) if abs(x) > 1e-12} == {b: round(x, 9) for b, x in dense[i].items()}
    asked = embedding.development(spark.createDataFrame([("q", "invoice for a customer"), ("none", "")], "q string, t string"), "q", "t")
    q = plain_vector("invoice for a customer")
    scores = sorted(((-round(sum(a * b for a, b in zip(q, plain_vector(t), strict=True)), 9), i) for i, t in enumerate(texts) if plain_vector(t)), key=lambda s: s)
    best = [(i, -s) for s, i in scores if s < 0][:3]
    got = embedding.similar(vectors, asked, "id", "q", 3).orderBy("rank").collect()
    assert [(r["id"], r["score"]) for r in got] == best
    stored = spark.createDataFrame([(0, 5, 1.0)], "id long, bucket long, weight double")
    assert embedding.with_stored(vectors, stored, "id").where("id = 0").count() == 1


def units(s):
    return len(s.encode("utf-16-le")) // 2


def plain_cut(s, most):
    out = ""
    for c in s:
        if units(out + c) > most:
            break
        out += c
    return out


def plain_name(s, most):
    stem, dot, end = s.rpartition(".")
    if units(s) <= most:
        return s
    if not stem or not end or units(end) > 16 or units(end) + 1 >= most:
        return plain_cut(s, most)
    return plain_cut(stem, most - units(end) - 1) + dot + end


def test_plain_paths_need_nothing(spark):
    """What one pattern finds plain has no fault and is left as it is; what it does not find goes the long way."""
    rng = random.Random(8)
    odd = ["con", "CON.txt", "Lpt1", "a ", "a.", " a", "a\n", "é", "", "a:b", "x\\y", "?", "." * 3, "a" * 65, "b" * 64, "nul.", "common", "com1x", "a.b", "#1", "_", "𝄞", None]
    names = odd + ["".join(rng.choice("aZ9 ._-#:\\éc") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    rows = spark.createDataFrame([(n,) for n in names], "n string").withColumns({"plain": F.rlike("n", F.lit(normalise.PLAIN_NAME)), "fault": normalise.component_fault(F.col("n"))})
    known = {r["n"]: r for r in rows.collect()}
    plain = [n for n, r in known.items() if r["plain"]]
    assert {"common", "com1x", "a.b", "#1", "_", "b" * 64} <= set(plain) and not set(plain) & set(odd[:14])
    assert all(known[n]["fault"] is None and plain_safe(n, 80, False) == n == plain_safe(n, 160, True) for n in plain)
    paths = [([rng.choice(names) for _ in range(rng.randint(0, 8))], rng.choice(names)) for _ in range(300)] + [([rng.choice(plain) for _ in range(rng.randint(0, 6))], rng.choice(plain)) for _ in range(100)]
    paths += [(["a\\b"], "c"), (["a"], None), ([], "a"), (["a" * 64] * 4, "b"), (["x"] * 7, "y"), ([None, "a"], "b")]
    # a blank in front of a name and none: the long way of the first must lead where the short way of the second does
    both = spark.createDataFrame([(i, f, n) for i, (f, n) in enumerate(paths)], "id int, folders array<string>, name string")
    long_way = both.withColumns({"folders": F.transform("folders", lambda x: F.concat(F.lit(" "), x)), "name": F.concat(F.lit(" "), "name")})
    fit = lambda df: {r["id"]: r["fit"] for r in pathfit.fitted(df, "folders", "name", 6).collect()}
    short, slow = fit(both), fit(long_way)
    assert all((short[i]["folders"], short[i]["name"], short[i]["valid"]) == (slow[i]["folders"], slow[i]["name"], slow[i]["valid"]) for i in short)
    assert all(short[i]["changed"] == ((short[i]["folders"], short[i]["name"]) != paths[i]) for i in short)


def test_buckets_hold_few_files_whatever_the_tasks(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    table = lineage.store_by(rows.repartition(60), "many", "k")
    assert table.count() == 1000 and len(table.inputFiles()) <= 8 * 8
    assert len(lineage.store_by(spread(rows, "k"), "dealt", "k").inputFiles()) <= 8


def plain_safe(s, most, name):
    s = re.sub(r'[<>:"|?*/\\\x00-\x1f\x7f-\x9f]+', "_", s.strip(" ")).rstrip(" .") or "Unclassified"
    if re.match(r"(?i)^(con|prn|aux|nul|(com|lpt)[1-9])([.].*)?$", s):
        s = "_" + s
    return plain_name(s, most) if name else plain_cut(s, most)


def plain_fit(folders, name, depth, most=240):
    made, called = [plain_safe(f, 80, False) for f in folders or []][:depth], plain_safe(name or "", 160, True)
    length = lambda: sum(map(units, made)) + units(called) + len(made)
    for i in reversed(range(len(made))):
        if length() <= most:
            break
        made[i] = plain_cut(made[i], 32)
    if length() > most:
        called = plain_name(called, max(16, most - sum(map(units, made)) - len(made)))
    return made, called, length() <= most


def test_paths_fit_in_utf16_units(spark):
    clef = "\U0001d11e"
    cases = [
        (["a"], "b.txt"), (["a" * 100] * 4, "n.pdf"), ([clef * 60, "x" * 79 + clef], clef * 200 + ".pdf"), (["l" + str(i) for i in range(9)], "deep"), (["CON", "a<b>", " . ", "..", "x."], "nul.txt"), ([], None), (None, "q" * 300 + "." + "e" * 20),
        ([clef * 40] * 6, "z" * 159 + "." + clef * 8), (["é" * 80] * 6, "é" * 200),
    ]
    rows = spark.createDataFrame([(i, f, n) for i, (f, n) in enumerate(cases)], "id long, folders array<string>, name string")
    for r in pathfit.fitted(rows, "folders", "name", 6).collect():
        assert (r["fit"]["folders"], r["fit"]["name"], r["fit"]["valid"]) == plain_fit(*cases[r["id"]], 6)
    names = spark.createDataFrame([("a.pdf",), (clef * 90 + ".pdf",), ("noending",), (".hidden",)], "n string")
    got = [r[0] for r in names.select(pathfit.numbered_name(F.col("n"), F.lit(12))).collect()]
    assert got == ["a_12.pdf", clef * 76 + "_12.pdf", "noending_12", ".hidden_12"]


def test_path_and_vector_queries(spark):
    rows = {r["doc_id"]: r for r in upkeep_queries.adapted(spark, SMALL, upkeep_queries.LONG_PATHS).collect()}
    for r in QUERIES["path_fitted"](spark, SMALL).collect():
        folders, name, valid = plain_fit(rows[r["doc_id"]]["folders"], rows[r["doc_id"]]["name"], 6)
        assert (r["folder"], r["name"], r["valid"]) == ("\\".join(folders), name, valid)
    docs = {r["doc_id"]: plain_vector(r["text"]) for r in upkeep_queries.adapted(spark, SMALL, upkeep_queries.TITLES).collect()}
    items = {r["item_id"]: plain_vector(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    got = defaultdict(list)
    for r in QUERIES["vector_semantic_topk"](spark, SMALL).collect():
        got[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    for item, q in items.items():
        best = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), i) for i, v in docs.items() if v)[:10]
        assert [round(-s, 6) for s, _ in best] == [round(s, 6) for _, _, s in sorted(got[item])]


def test_vectors_are_added_up_where_few_texts_are_dealt(spark, monkeypatch):
    """A task holds the buckets of so many texts, whatever a file holds: they are dealt before they are cut into features, and never again."""
    monkeypatch.setattr(embedding, "TEXTS_A_TASK", 2)
    docs = spark.createDataFrame([(i, f"invoice {i} note") for i in range(9)] + [(0, "more"), (None, "none")], "id long, t string").coalesce(1)
    made = embedding.development(docs, "id", "t")
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan and plan.index("Exchange") > plan.rindex("HashAggregate")
    assert made.rdd.getNumPartitions() <= 6
    vectors = {i: sorted((r["bucket"], round(r["weight"], 9)) for r in made.collect() if r["id"] == i) for i in (0, 8)}
    monkeypatch.setattr(embedding, "TEXTS_A_TASK", 100)
    whole = embedding.development(docs, "id", "t").collect()
    assert vectors == {i: sorted((r["bucket"], round(r["weight"], 9)) for r in whole if r["id"] == i) for i in (0, 8)} and all(vectors.values())


def test_signals_are_dealt_once(spark):
    sources = spark.createDataFrame([(1, "a", "person", 10), (1, "b", "person", 50), (2, "c", "project", None), (None, "d", "person", 1)], "doc long, source_id string, kind string, start long")
    signals = spark.createDataFrame([(1, "s", "email", 20), (1, "t", "phone", 30), (2, "u", "project_reference", 7), (2, "v", "email", 7), (None, "w", "email", 1)], "doc long, signal_id string, signal string, start long")
    found = matching.attached(sources, signals, "doc")
    assert {tuple(r) for r in found.collect()} == {(1, "s", "a"), (2, "u", "c")}
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_numbers_go_on_where_the_last_search_ended():
    n = 12_000
    own = [(i, f"a_{i}", f"a_{i}") for i in range(2, n)]
    rows = pd.DataFrame([(i, k, s, "", False) for i, k, s in own] + [(n + i, "a", "a", "", False) for i in range(n)], columns=["file_id", "key", "stem", "ending", "overridden"])
    began = time.monotonic()
    got = proposals._one_by_one(rows)
    assert time.monotonic() - began < 5
    numbers = got[got["file_id"] >= n]["number"].tolist()
    assert numbers == [0, *range(n, 2 * n - 1)]


def test_a_family_holds_its_stems_and_not_its_files(spark):
    """Numbers as from a pass that remembers every name; a family in many batches; memory by distinct stems."""

    def names_remembered(rows):
        seen, out = Counter(), []
        for i, stem, mine in sorted(rows):
            seen[stem] += 1
            ordinal, number = seen[stem], 0
            if ordinal > 1 and not mine:
                number = ordinal
                while f"{stem}_{number}" in seen:
                    number += 1
                seen[f"{stem}_{number}"] = 1
            out.append((i, ordinal, number))
        return out

    rng = random.Random(5)
    for _ in range(200):
        rows = [(i, rng.choice(["a", "a", "a_2", "a_3", "a_2_2", "a_02", "a_", "a_4", "a_²"]), rng.random() < 0.2) for i in range(40)]
        frame = pd.DataFrame([(i, s, s, "", m) for i, s, m in rows], columns=["file_id", "key", "stem", "ending", "overridden"])
        assert [tuple(map(int, r)) for r in proposals._one_by_one(frame).itertuples(index=False)] == names_remembered(rows)
    family = proposals._Family()
    assert [family.add("a", False) for _ in range(5000)][-1] == (5000, 5000) and family.add("a_77", False) == (2, 2)
    assert len(family.count) == 2 and family.runs == {"a": [[2, 5000]], "a_77": [[2, 2]]}
    two = pd.DataFrame([("f", e, i, "f", False) for e in (".a", ".b") for i in range(6)], columns=["family", "ending", "file_id", "stem", "overridden"])
    told = pa.Table.from_batches(list(proposals._family_by_family(pa.Table.from_pandas(two).to_batches(4)))).to_pydict()
    assert told["number"] == [0, 2, 3, 4, 5, 6] * 2 and told["file_id"] == [*range(6)] * 2


def test_the_whole_proposal_runs_alone_and_wide_rows_stay_in_their_buckets(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        wide = lineage.store_by(spark.range(2000).select(F.col("id").alias("file_id"), F.lit("x").alias("text")), "wide", "file_id")
        met = wide.join(hashed(spark.range(0, 2000, 7).select(F.col("id").alias("file_id"))), "file_id", "left_anti")
        assert met.count() == 2000 - 286
        plan = met._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange") == 1 and "ShuffledHashJoin" in plan and "Sort " not in plan
    finally:
        spark.conf.set(key, before)
    assert proposal_queries._whole(spark, SMALL).versions()[0] == 1
    other = f"{SMALL}/."
    QUERIES["organize_build"](spark, other)
    assert proposal_queries._whole(spark, other).versions() == [1]
