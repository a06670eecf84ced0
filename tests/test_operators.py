"""Edge cases of the engine's operators, and streams against their batch twins."""

from __future__ import annotations

from compare import run_sql, same_rows
from conftest import LARGEST, SMALL
from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import catalog, identity, index, maintenance, organize, search, understanding, vectors
from folio.plans import catalogue
from folio.plans.components import components
from folio.plans.prefix import running_total
from folio.sources.adapters import WATCH, adapted
from folio.streaming import watch


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(6, 60)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in range(5, 60)}}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_running_total_crosses_buckets(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("g"), F.lit(2).alias("w"))
    got = running_total(df, ["g"], F.expr("id div 100"), ["id"], F.col("w"), "t").toPandas().sort_values("id")
    for _, own in got.groupby("g"):
        assert own["t"].tolist() == [2 * i for i in range(len(own))]


def test_catalogue_on_missing_values(spark):
    files = spark.createDataFrame([(1, None, 5), (2, None, 5), (3, "d", 5), (4, "d", 5), (5, "d", 6)], "file_id long, digest string, byte_size long")
    assert [tuple(r) for r in catalog.exact_duplicates(files).collect()] == [(5, "d", 2, 3)]
    assert catalog.size_collisions(files).count() == 4
    assert catalog.exact_duplicates(files.limit(0)).count() == 0
    page = catalog.inventory_page(files.withColumn("digest", F.when(F.col("file_id") == 2, None).otherwise("x")), "digest", True, 4, 5)
    assert [r["file_id"] for r in page.collect()] == [2]


def test_money_and_dates(spark):
    docs = spark.createDataFrame([(1, "12.50 EUR, 3 USD and 7.5 GBP"), (2, None), (3, "on 2024-02-30 and 2024-02-29")], "id long, t string")
    got = understanding.money(docs, "id", "t").orderBy("position").collect()
    assert [(r["amount_minor"], r["currency"]) for r in got] == [(1250, "EUR"), (300, "USD"), (500, "GBP")]
    assert [r["iso_date"] for r in understanding.iso_dates(docs, "id", "t").collect()] == ["2024-02-29"]


def test_resolution_conflicts_and_support(spark):
    rows = [(1, "a", 0.7), (1, "a", 0.6), (2, "a", 0.7), (2, "b", 0.68), (3, "a", 0.3), (4, "a", 0.9)]
    got = understanding.resolve(spark.createDataFrame(rows, "id long, v string, c double"), ["id"], "v", "c")
    assert {r["id"]: (r["v"], r["status"]) for r in got.collect()} == {1: ("a", "inferred"), 2: (None, "conflicting"), 3: (None, "unknown"), 4: ("a", "confirmed")}


def test_resolution_is_free_of_rounding_errors(spark):
    # .85, but a sum of doubles falls short of it by one bit
    rows = [(1, "a", c) for c in (0.47, 0.52, 0.58, 0.41, 0.1)]
    got = understanding.resolve(spark.createDataFrame(rows, "id long, v string, c double").coalesce(1), ["id"], "v", "c").first()
    assert (got["v"], got["confidence"], got["status"]) == ("a", 0.85, "confirmed")


def test_review_reasons_equal_the_sql_where_confidences_tie(spark):
    same_rows(catalogue.QUERIES["semantic_review_reasons"](spark, LARGEST), run_sql(catalogue.ORACLES["semantic_review_reasons"], LARGEST))


def test_assessment_rules(spark):
    rows = [
        ("a", "Acme SAS", "acme.example", "X1"), ("b", "ACME sas", "acme.example", "X1"),
        ("c", "Acme SARL", "acme.example", None), ("d", "Acme SAS", "gmail.com", "X2"),
    ]
    occ = identity.prepared(spark.createDataFrame(rows, "occurrence_key string, original_value string, domain string, company_identifier string"))
    got = {(r["a"], r["b"]): r["decision"] for r in identity.assess(identity.candidate_pairs(identity.blocking_keys(occ)), occ).collect()}
    assert got[("a", "b")] == "auto_link" and got[("a", "c")] == "review" and got[("a", "d")] == "keep_separate"


def test_collisions_ignore_case(spark):
    rows = spark.createDataFrame([(1, "X", "a.txt"), (2, "x", "A.TXT"), (3, "x", "noext"), (4, "X", "NoExt")], "id long, f string, n string")
    got = {r["id"]: r["final_name"] for r in organize.collision_names(rows, "id", "f", "n").collect()}
    assert got == {1: "a.txt", 2: "A_2.TXT", 3: "noext", 4: "NoExt_2"}


def test_broken_chain(spark):
    rows = [("e", 0, "d0", None), ("e", 1, "d1", "d0"), ("e", 2, "d2", "bad"), ("e", 4, "d4", "d2")]
    got = organize.broken_chain(spark.createDataFrame(rows, "k string, seq long, d string, p string"), ["k"], "seq", "seq", "d", "p", span=2)
    assert sorted(r["seq"] for r in got.collect()) == [2, 4]


def test_coalescing_lattice(spark):
    rows = [("p", 1, "created"), ("p", 2, "modified"), ("q", 1, "removed"), ("q", 2, "created"), ("r", 1, "created"), ("r", 2, "removed"), ("s", 1, "metadata"), ("s", 2, "moved"), ("t", 3, "rescan"), ("t", 4, "removed")]
    got = watch.coalesced(spark.createDataFrame(rows, "path string, seq long, kind string"), ["path"], ["seq"])
    assert {r["path"]: r["kind"] for r in got.collect()} == {"p": "created", "q": "modified", "r": "removed", "s": "moved", "t": "rescan"}


def test_debounce_stream_equals_batch(spark, tmp_path):
    events = adapted(spark, SMALL, WATCH).withColumn("ts", F.timestamp_millis("at_ms"))
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    found = watch.debounced_stream(stream, ["root_id", "path"], "ts", "seq", "6 hours", "0 seconds")
    run = found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    got = spark.read.parquet(str(tmp_path / "out")).select("root_id", "path", F.unix_millis("started").alias("started"), F.unix_millis("ready").alias("ready"), "hints", "kind")
    batch = watch.debounced(events, ["root_id", "path"], "at_ms", "seq", 6 * 3_600_000).select(*got.columns)
    assert got.count() > 0 and got.exceptAll(batch).count() == 0


def test_coalesced_stream_and_maintained_state(spark, tmp_path):
    events = adapted(spark, SMALL, WATCH).withColumn("ts", F.timestamp_millis("at_ms"))
    events.repartition(1).write.parquet(str(tmp_path / "one"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    read = lambda name: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    run = watch.coalesced_stream(read("one"), ["root_id", "path"], "ts", "seq", "6 hours", "0 seconds").writeStream.format("parquet")
    run = run.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(300)
    numbered = events.withColumn("poll", F.sum(F.expr("int(coalesce(at_ms - lag(at_ms) over (partition by root_id, path order by at_ms, seq) >= 21600000, true))")).over(
        Window.partitionBy("root_id", "path").orderBy("at_ms", "seq")))
    starts = numbered.groupBy("root_id", "path", "poll").agg(F.min("ts").alias("started"))
    batch = watch.coalesced(numbered, ["root_id", "path", "poll"], ["at_ms", "seq"]).join(starts, ["root_id", "path", "poll"])
    got = spark.read.parquet(str(tmp_path / "out")).select("root_id", "path", "started", "hints", "kind")
    assert got.count() > 0 and got.exceptAll(batch.select(*got.columns)).count() == 0
    stream = read("in")
    kept = watch.maintained(stream, ["root_id", "path"], ["at_ms", "seq"], str(tmp_path / "state"), str(tmp_path / "cp2"))
    kept.awaitTermination(300)
    last = spark.read.schema(events.schema).parquet(str(tmp_path / f"state/state={kept.lastProgress['batchId']}"))
    assert sorted(map(tuple, last.select("root_id", "path", "seq").collect())) == sorted(
        map(tuple, events.groupBy("root_id", "path").agg(F.max_by("seq", F.struct("at_ms", "seq"))).collect())
    )


def test_nearest_in_blocks(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(40)] + [(40, None), (None, [1.0, 1.0]), (41, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    got = vectors.nearest(df, df.where("id % 10 = 2 or id = 41"), "id", "v", 3, block_rows=2).collect()
    flat = [(i, v) for i, v in rows if i is not None and v is not None]
    for q, v in (r for r in flat if r[0] % 10 == 2 or r[0] == 41):
        best = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), i) for i, w in flat if len(w) == len(v)))[:3]
        assert [(r["id"], -r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [(i, s) for s, i in best]
    assert vectors.nearest(df, df.limit(0), "id", "v", 3).count() == 0 and vectors.nearest(df.limit(0), df, "id", "v", 3).count() == 0


def test_similarity_needs_equal_lengths(spark):
    row = spark.createDataFrame([([1.0, 0.0], [0.5, 0.5], [1.0])], "a array<double>, b array<double>, c array<double>")
    got = row.select(search.dot(F.col("a"), F.col("b")), search.dot(F.col("a"), F.col("c")), search.quantise(F.col("b"))).first()
    assert (got[0], got[1], got[2]) == (0.5, None, [64, 64])


def test_an_index_counts_tokens_within_rows(spark, tmp_path):
    rows = [(1, "Aa bb aa", "bb"), (2, "aa", None), (2, "aa", None), (3, None, ""), (None, "bb bb cc", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2)
    path = str(tmp_path / "index")
    index.build(docs, "doc_id", ["text", "source"], path)
    # repeated rows of one id and lengths are one document, as in the SQL's grouping
    found = index.postings(spark, path, ["aa", "bb"], {"text": 1.0, "source": 3.5}, "doc_id")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "aa", 2.0, 4), (1, "bb", 4.5, 4), (2, "aa", 2.0, 1), (None, "bb", 2.0, 3)], key=str)


def test_token_counts_gather_only_repeated_ids(spark):
    docs = spark.createDataFrame([(1, "bb Aa bb"), (2, "aa"), (2, "aa cc"), (3, None), (None, "dd"), (None, "dd")], "doc_id long, text string")
    got = {tuple(r) for r in search.token_counts(docs, "doc_id", "text").collect()}
    assert got == {(1, "aa", 1), (1, "bb", 2), (2, "aa", 2), (2, "cc", 1), (None, "dd", 2)}
    plan = search.token_counts(docs.where("doc_id = 1"), "doc_id", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert not plan.startswith("Aggregate")


def test_differences_of_documents_equal_those_of_rows(spark):
    a = search.token_lists(spark.createDataFrame([(1, "aa bb"), (2, "cc"), (3, "dd")], "doc_id long, text string"), "doc_id", "text")
    b = search.token_lists(spark.createDataFrame([(1, "aa bb bb"), (2, "cc"), (4, "ee")], "doc_id long, text string"), "doc_id", "text")
    got = {tuple(r) for r in maintenance.document_differences(a, b, "doc_id", "counts").collect()}
    assert got == {(1, "bb", 1, "stale"), (1, "bb", 2, "absent"), (3, "dd", 1, "stale"), (4, "ee", 1, "absent")}
