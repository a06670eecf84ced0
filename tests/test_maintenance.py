"""Merges, history and derived tables on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from folio.operators import maintenance, organize


def test_upsert_is_idempotent(spark):
    schema = "k long, at long, v string"
    current = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, None)], schema)
    changes = spark.createDataFrame([(1, 2, "c"), (1, 0, "late"), (2, 3, "gone"), (4, 1, "new"), (4, 1, "new")], schema)
    once = maintenance.upsert(current, changes, ["k"], ["at"], F.col("v") == "gone")
    assert {tuple(r) for r in once.collect()} == {(1, 2, "c"), (3, 1, None), (4, 1, "new")}
    assert once.exceptAll(maintenance.upsert(once, changes, ["k"], ["at"], F.col("v") == "gone")).count() == 0


def test_history_merge(spark):
    history = spark.createDataFrame([("a", "x", 1, 0, 5), ("a", "y", 2, 5, None), ("b", None, 1, 0, None)], "k string, v string, version long, valid_from long, valid_to long")
    seen = spark.createDataFrame([("a", 6, "y"), ("a", 7, "z"), ("a", 7, "z"), ("b", 3, None), ("b", 4, "q"), ("c", 1, "n")], "k string, at long, v string")
    got = {tuple(r) for r in maintenance.scd2_merge(history, seen, ["k"], "at", ["v"]).collect()}
    assert got == {("a", "x", 1, 0, 5), ("a", "y", 2, 5, 7), ("a", "z", 3, 7, None), ("b", None, 1, 0, 4), ("b", "q", 2, 4, None), ("c", "n", 1, 1, None)}
    again = maintenance.scd2_merge(history, seen.limit(0), ["k"], "at", ["v"])
    assert again.exceptAll(history.select(*again.columns)).count() == 0


def test_index_replacement_and_check(spark):
    index = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "c")], "id long, token string")
    changed = spark.createDataFrame([(1, "z z"), (4, "w"), (3, None)], "id long, t string")
    build = lambda rows: rows.select("id", F.explode(F.split("t", " ")).alias("token"))
    new = maintenance.replaced_index(index, changed, "id", build)
    assert sorted(tuple(r) for r in new.collect()) == [(1, "z"), (1, "z"), (2, "a"), (4, "w")]
    wrong = maintenance.index_differences(new, spark.createDataFrame([(1, "z"), (2, "a"), (4, "w"), (5, "v")], "id long, token string"))
    assert {tuple(r) for r in wrong.collect()} == {(1, "z", "stale"), (5, "v", "absent")}


def test_neighbourhood_is_one_hop(spark):
    keys = spark.createDataFrame([(1, "c", "x"), (2, "c", "x"), (2, "c", "y"), (3, "c", "y"), (4, "d", "x"), (5, "c", None), (6, "c", None)], "id long, kind string, key string")
    near = maintenance.neighbourhood(keys, spark.createDataFrame([(1,), (9,), (5,)], "id long"), "id")
    assert sorted(r["id"] for r in near.collect()) == [1, 2, 5, 9]


def test_drift_and_synchronisation(spark):
    planned = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 3)], "k long, p string, n long")
    now = spark.createDataFrame([(1, "a", 2), (2, "b", None), (4, "d", 4)], "k long, p string, n long")
    assert {tuple(r) for r in maintenance.drift(planned, now, ["k"], ["p", "n"]).collect()} == {(1, "n"), (3, "missing")}
    got = maintenance.synchronised(planned, now, ["k"], "n")
    assert {tuple(r) for r in got.collect()} == {(1, 2, "update"), (2, None, "keep"), (3, 3, "retire"), (4, 4, "insert")}


def test_vetoes_overlays_and_work(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    assert [tuple(r) for r in maintenance.vetoed(pairs, spark.createDataFrame([("b", "a")], "a string, b string")).collect()] == [("b", "c")]
    machine = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    fixes = spark.createDataFrame([(1, 1, "p"), (1, 2, None), (9, 1, "z")], "k long, at long, v string")
    assert {tuple(r) for r in maintenance.overlay(machine, fixes, ["k"], "v", ["at"]).select("k", "v", "corrected").collect()} == {(1, None, True), (2, "y", False)}
    left = maintenance.to_process(spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "k long, v string"), spark.createDataFrame([(1, "a"), (2, None), (3, "old")], "k long, v string"), ["k"], ["v"])
    assert sorted(r["k"] for r in left.collect()) == [3, 4]


def test_collapse_leaves_no_small_folder(spark):
    rows = [("r/a/x",)] * 5 + [("r/a/y",)] + [("r/b/z",)] + [("r/c",)] * 4
    got = {r["folder"]: r["collapsed"] for r in organize.collapse_groups(spark.createDataFrame(rows, "f string"), "f", 3).withColumnRenamed("f", "folder").collect()}
    assert got == {"r/a/x": "r/a/x", "r/a/y": "r", "r/b/z": "r", "r/c": "r/c"}
