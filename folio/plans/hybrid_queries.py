"""Queries of the hybrid search: index, candidates, relevance and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folio.operators import hybrid, index, ranking, search
from folio.plans.registry import FACTS_SQL, FILES_SQL, TOKENS_SQL, asked_tokens, files, query, text_index
from folio.sources.adapters import FACTS, FILES, adapted, plain
from folio.sources.tables import table

WEIGHTS = {"filename": 8.0, "path": 3.5, "text": 1.0, "metadata": 0.5}
_toks = lambda c: TOKENS_SQL.replace("text", c)
_part = lambda c, w: f"list_transform({_toks(c)}, lambda t: {{'t': t, 'w': {w}::DOUBLE}})"
BM25_SQL = f"""WITH asked AS (SELECT DISTINCT unnest(list_slice({TOKENS_SQL}, 1, 6)) AS token FROM benchmark WHERE item_id = (SELECT min(item_id) FROM benchmark)), files AS ({plain(FILES)}),
  parts AS (SELECT file_id, list_concat(list_concat({_part('filename', 8.0)}, {_part('parent_path', 3.5)}), list_concat({_part('text', 1.0)}, {_part('lang', 0.5)})) AS p FROM files),
  sized AS (SELECT file_id, p, len(p) AS length, avg(len(p)) OVER () AS mean FROM parts),
  tf AS (SELECT file_id, length, mean, u.t AS token, sum(u.w)::DOUBLE AS f FROM (SELECT file_id, length, mean, unnest(p) AS u FROM sized) AS x WHERE u.t IN (SELECT token FROM asked) GROUP BY ALL),
  dfs AS (SELECT token, count(*) AS df FROM tf GROUP BY token), n AS (SELECT count(*) AS n FROM files),
  bm AS (SELECT file_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * length / mean))) AS b FROM tf JOIN dfs USING (token), n GROUP BY file_id)"""


def _bm25(spark, sf_dir):
    return index.bm25(spark, text_index(spark, sf_dir), "doc_id", WEIGHTS, asked_tokens(spark, sf_dir)).withColumnRenamed("doc_id", "file_id")


@query(f"{BM25_SQL} SELECT file_id, round(b, 6) AS score, round(1 / (1 + exp(-b)), 6) AS hybrid_score, round(1 - 1 / (1 + abs(b)), 6) AS plain_score FROM bm")
def search_bm25_indexed(spark, sf_dir):
    found = _bm25(spark, sf_dir)
    return found.select("file_id", *[F.round(c, 6).alias(n) for c, n in ((F.col("score"), "score"), (hybrid.squashed(F.col("score")), "hybrid_score"), (hybrid.squashed(F.col("score"), True), "plain_score"))])


CANDIDATES_SQL = f"""{BM25_SQL}, facts AS ({plain(FACTS)}), lex AS (SELECT file_id, round(1 / (1 + exp(-b)), 6) AS score FROM bm ORDER BY round(1 / (1 + exp(-b)), 6) DESC, file_id LIMIT 2500),
  structured AS (SELECT file_id FROM facts WHERE currency = 'EUR' AND amount_minor BETWEEN 9000000 AND 11000000 ORDER BY file_id LIMIT 2500),
  q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)),
  vec AS (SELECT * FROM (SELECT vec_id AS file_id, round(list_inner_product(embedding::DOUBLE[], e::DOUBLE[]), 6) AS score FROM embeddings, q) AS s WHERE score >= 0.1 ORDER BY score DESC, file_id LIMIT 2000),
  cands AS (SELECT file_id, max(l) AS lexical, max(v) AS vector, bool_or(s) AS structured FROM (SELECT file_id, score AS l, NULL::DOUBLE AS v, false AS s FROM lex UNION ALL SELECT file_id, NULL, NULL, true FROM structured UNION ALL SELECT file_id, NULL, score, false FROM vec) AS u GROUP BY file_id),
  ranked AS (SELECT *, CASE WHEN coalesce(lexical, 0) + coalesce(vector, 0) = 0 AND structured THEN 0.5 ELSE coalesce(lexical, 0) + coalesce(vector, 0) END AS priority FROM cands ORDER BY priority DESC, file_id LIMIT 20000)"""


def _candidates(spark, sf_dir):
    lexical = _bm25(spark, sf_dir).select("file_id", F.round(hybrid.squashed(F.col("score")), 6).alias("score"))
    facts = adapted(spark, sf_dir, FACTS).where("currency = 'EUR' AND amount_minor BETWEEN 9000000 AND 11000000")
    rows = table(spark, sf_dir, "embeddings")
    first = rows.orderBy("vec_id").select("embedding").first()
    target = F.array(*[F.lit(float(x)) for x in (first["embedding"] if first else [])])
    near = rows.select(F.col("vec_id").alias("file_id"), F.round(search.dot(F.col("embedding"), target), 6).alias("score"))
    return hybrid.candidates(lexical, facts, hybrid.vector_seeds(near, "file_id"), "file_id", files(spark, sf_dir))


@query(f"{CANDIDATES_SQL} SELECT file_id, lexical, vector, structured, round(priority, 6)::DOUBLE AS priority FROM ranked")
def search_candidates_union(spark, sf_dir):
    return _candidates(spark, sf_dir).withColumn("priority", F.round("priority", 6))


HYBRID_SQL = f"""{CANDIDATES_SQL}, rows AS (SELECT file_id, user_confirmed AS u, confidence::DOUBLE AS c, CASE WHEN file_id % 3 = 0 THEN confidence::DOUBLE ELSE 0 END AS t, CASE WHEN file_id % 2 = 0 THEN confidence::DOUBLE ELSE 0 END AS x,
    CASE WHEN ends_with(customer_name, '7') THEN confidence::DOUBLE ELSE 0 END AS p, CASE WHEN currency = 'EUR' AND amount_minor BETWEEN 9000000 AND 11000000 THEN greatest(0, 1 - abs(amount_minor - 10000000) / 10000000.0) ELSE 0 END::DOUBLE AS a,
    CASE WHEN substr(iso_date, 1, 4) = '1996' THEN 1 ELSE 0 END::DOUBLE AS d FROM facts),
  w AS (SELECT ranked.*, u, t, x, p, a, d, coalesce(u AND (t <= 0 OR x <= 0 OR p <= 0 OR a <= 0 OR d <= 0), false) AS wrong FROM ranked LEFT JOIN rows USING (file_id)),
  weighed AS (SELECT *, CASE WHEN u THEN 0.08 ELSE 0 END AS plus, 0.34 * least(coalesce(lexical, 0), 1) AS pl, CASE WHEN coalesce(vector, 0) >= 0.18 THEN 0.1 * least((vector - 0.18) / 0.82, 1) ELSE 0 END AS pv FROM w),
  named AS (SELECT *, CASE WHEN t > 0 THEN 0.2 * t + plus ELSE 0 END AS pt, CASE WHEN x > 0 THEN 0.08 * x + plus ELSE 0 END AS px, CASE WHEN p > 0 THEN 0.24 * greatest(p, 0.7) + plus ELSE 0 END AS pp, CASE WHEN a > 0 THEN 0.18 * a + plus ELSE 0 END AS pa, CASE WHEN d > 0 THEN 0.12 * d + plus ELSE 0 END AS pd FROM weighed),
  scored AS (SELECT file_id, pl + pv + pt + px + pp + pa + pd + CASE WHEN file_id % 10 = 0 THEN 0.25 ELSE 0 END - CASE WHEN wrong THEN 0.8 ELSE 0 END AS relevance,
    concat_ws(',', CASE WHEN pl > 0 THEN 'lexical' END, CASE WHEN pv > 0 THEN 'vector' END, CASE WHEN pt > 0 THEN 'document_type' END, CASE WHEN px > 0 THEN 'context' END, CASE WHEN pp > 0 THEN 'customer' END, CASE WHEN pa > 0 THEN 'amount' END, CASE WHEN pd > 0 THEN 'date' END, CASE WHEN wrong THEN 'mismatch' END) AS explanation
    FROM named WHERE greatest(pl, pv, pt, px, pp, pa, pd) > 0),
  kept AS (SELECT file_id, least(relevance, 1)::DOUBLE AS relevance, explanation FROM scored WHERE relevance >= 0.035)"""


def _relevant(spark, sf_dir):
    rows = adapted(spark, sf_dir, FACTS).withColumn("c", F.col("confidence").cast("double"))
    conf = lambda match: F.when(match, F.col("c")).otherwise(0.0)
    amount = F.when(F.col("currency") == "EUR", ranking.amount_similarity(F.col("amount_minor"), 9_000_000, 11_000_000, 10_000_000)).otherwise(0.0)
    intents = {
        "document_type": conf(F.col("file_id") % 3 == 0), "context": conf(F.col("file_id") % 2 == 0), "customer": conf(F.endswith("customer_name", F.lit("7"))),
        "amount": amount, "date": F.when(F.substring("iso_date", 1, 4) == "1996", 1.0).otherwise(0.0),
    }
    scores = hybrid.evidence_scores(rows, "file_id", intents, F.col("user_confirmed"))
    boost = F.when(F.col("file_id") % 10 == 0, 0.4).otherwise(0.0)
    return hybrid.relevance(_candidates(spark, sf_dir), scores, "file_id", list(intents), boost)


@query(f"{HYBRID_SQL} SELECT file_id, round(relevance, 6) AS relevance, explanation FROM kept")
def search_hybrid_full(spark, sf_dir):
    return _relevant(spark, sf_dir).withColumn("relevance", F.round("relevance", 6))


@query(f"{HYBRID_SQL} SELECT k.file_id, filename, round(relevance, 6) AS relevance FROM (SELECT file_id, round(relevance, 6) AS relevance FROM kept) AS k JOIN files USING (file_id) ORDER BY relevance DESC, lower(filename), k.file_id LIMIT 20")
def search_result_page(spark, sf_dir):
    found = _relevant(spark, sf_dir).withColumn("relevance", F.round("relevance", 6)).join(files(spark, sf_dir).select("file_id", "filename"), "file_id")
    return hybrid.sorted_page(found, "relevance", "file_id", 0, 20).select("file_id", "filename", "relevance")


_SORTS = {"filename": "lower(filename)", "size": "byte_size DESC NULLS LAST, lower(filename)", "newest": "modified_ms DESC NULLS FIRST, lower(filename)", "oldest": "modified_ms ASC NULLS LAST, lower(filename)", "newest_last": "modified_ms DESC NULLS LAST, lower(filename)"}


@query(f"{FILES_SQL}, f AS (SELECT file_id, filename, byte_size, CASE WHEN file_id % 7 <> 0 THEN modified_ms END AS modified_ms FROM files) " + " UNION ALL ".join(f"(SELECT '{k}' AS sort, file_id, row_number() OVER (ORDER BY {o}, file_id) AS place FROM f ORDER BY place LIMIT 15)" for k, o in _SORTS.items()))
def search_sorted_pages(spark, sf_dir):
    rows = files(spark, sf_dir).select("file_id", "filename", "byte_size", F.when(F.col("file_id") % 7 != 0, F.col("modified_ms")).alias("modified_ms"))
    out = None
    for how in _SORTS:
        page = hybrid.sorted_page(rows, how, "file_id", 0, 15).withColumn("_n", F.monotonically_increasing_id())
        part = page.select(F.lit(how).alias("sort"), "file_id", F.row_number().over(Window.orderBy("_n")).cast("long").alias("place"))
        out = part if out is None else out.unionByName(part)
    return out
