"""Toxicity and quality on held-out rows, licences and page text on planted cases, and the pipeline."""

from __future__ import annotations

import random
import re
import textwrap
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pytest
from conftest import LARGER, LARGEST, SMALL
from pyspark.sql import functions as F
from test_counting_operators import brute_classes, brute_contamination, brute_print, documents

import corpus_pipeline
from folio.llm import html_text, license_scan, quality_ranking, queries, toxic_spans
from folio.llm.training_rows import held_out


def area(scores, labels):
    """Chance that a row of label 1 scores above one of label 0, ties counting half."""
    ranks, pos = pd.Series(scores).rank().to_numpy(), labels == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize("query, label, folder", [(queries.op4_toxic_spans, "toxic", LARGEST), (queries.op5_quality_ranking, "quality", LARGER)])
def test_held_out_ranking(spark, query, label, folder):
    got = query(spark, folder).toPandas()
    docs = spark.read.parquet(f"{folder}/documents.parquet").count()
    assert len(got) == docs and got["score"].between(0, 1).all()
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got["doc_id"]]
    labels = spark.read.parquet(f"{folder}/labels.parquet").toPandas().groupby("doc_id")[label].max()
    known = got[got["held_out"] & got["doc_id"].isin(labels.index)]
    marks = labels[known["doc_id"]].to_numpy()
    assert area(known["score"].to_numpy(), marks) >= 0.93


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    emit, move, start = rng.normal(size=(1, 4)), rng.normal(size=(2, 2)), rng.normal(size=2)
    p, moves, starts, z = toxic_spans.chain_marginals(emit, np.ones((1, 4), dtype=bool), move, start)
    total, each = 0.0, np.zeros(4)
    for path in np.ndindex(2, 2, 2, 2):
        s = start[path[0]] + sum(emit[0, t] * path[t] for t in range(4)) + sum(move[path[t], path[t + 1]] for t in range(3))
        total += np.exp(s)
        each += np.exp(s) * np.array(path)
    assert np.allclose(p[0], each / total) and np.isclose(z, np.log(total)) and np.isclose(moves.sum(), 3) and np.isclose(starts.sum(), 1)


def test_whole_texts_are_one_chain(spark):
    rng = np.random.default_rng(2)
    move, start = rng.normal(size=(2, 2)) * 2, rng.normal(size=2)
    model = toxic_spans.ToxicModel({"bad": 3.0, "worse": 5.0}, -2.0, move, start)
    texts = [" ".join(rng.choice(["bad", "worse", "fine", "ok"], size=n)) for n in (0, 1, 63, 64, 65, 128, 500, 20_000)] + [None, ""]
    words, p, begin = model.tag(texts)
    for k, text in enumerate(texts):
        own = p[begin[k] : begin[k + 1]]
        ws = (text or "").split()
        assert words[k] == ws and len(own) == len(ws)
        if not ws:
            continue
        e = np.array([[0.0, model.emission(w)] for w in ws])
        a, b = np.zeros((len(ws), 2)), np.zeros((len(ws), 2))
        a[0] = start + e[0]
        for t in range(1, len(ws)):
            a[t] = np.logaddexp(a[t - 1][0] + move[0], a[t - 1][1] + move[1]) + e[t]
        for t in range(len(ws) - 2, -1, -1):
            b[t] = np.logaddexp(*(move[:, j] + e[t + 1][j] + b[t + 1][j] for j in (0, 1)))
        log = a + b
        assert np.allclose(own, np.exp(log[:, 1] - np.logaddexp(log[:, 0], log[:, 1])), atol=1e-9)


def test_fitted_chain_is_at_an_optimum():
    windows = [["kind", "bad", "word"], ["bad", "bad"], ["kind", "word"], ["odd", "bad"], ["word"]]
    labels = [[0, 1, 0], [1, 1], [0, 0], [toxic_spans.UNKNOWN, 1], [0]]
    features = ["bad", "odd", "kind"]
    model = toxic_spans.fit_chain(windows, labels, features, ridge=1e-2, steps=4000)

    def loss(theta):
        weights, bias, move, start = dict(zip(features, theta[:3], strict=True)), theta[3], theta[4:8].reshape(2, 2), theta[8:]
        out = 0.0
        for ws, ys in zip(windows, labels, strict=True):
            score = lambda path: start[path[0]] + sum(weights.get(w, 0.0) * s + bias * s for w, s in zip(ws, path, strict=True)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
            every = list(np.ndindex(*[2] * len(ws)))
            held = [p for p in every if all(y in (toxic_spans.UNKNOWN, s) for y, s in zip(ys, p, strict=True))]
            out += np.logaddexp.reduce([score(p) for p in every]) - np.logaddexp.reduce([score(p) for p in held])
        return out / len(windows) + 0.5e-2 * theta @ theta

    theta = np.array([*[model.weights[f] for f in features], model.bias, *model.move.ravel(), *model.start])
    for k in range(len(theta)):
        bump = np.zeros(len(theta))
        bump[k] = 1e-4
        assert abs(loss(theta + bump) - loss(theta - bump)) / 2e-4 < 2e-3


def test_quality_fit_is_at_an_optimum_and_ties_agree():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(size=(30, 4)) + 0.7, rng.normal(size=(30, 4))])
    labels = np.repeat([1, 0], 30)
    model = quality_ranking.fit(rows, labels, {0: 300, 1: 30}, pairs=500, ridge=1.0)
    x = quality_ranking.expand(rows, model.mean, model.scale)
    draw = np.random.default_rng(7)
    better, worse = draw.choice(np.flatnonzero(labels == 1), 500), draw.choice(np.flatnonzero(labels == 0), 500)
    loss = lambda w: np.log1p(np.exp(-(x[better] - x[worse]) @ w)).sum() + 0.5 * w @ w
    for k in range(8):
        bump = np.zeros(8)
        bump[k] = 1e-4
        assert abs(loss(model.weights + bump) - loss(model.weights - bump)) / 2e-4 < 1e-2
    scores = model.score(np.vstack([rows[:1], rows[:1], rows[1:2]]))
    assert scores[0] == scores[1] and np.array_equal(np.argsort(model.raw(rows)), np.argsort(model.score(rows)))


def test_quality_learns_from_all_labelled_rows(spark, monkeypatch):
    docs = documents(spark, [(k, "word " * (5 + k % 7) if k % 3 else "x!? " * (1 + k % 5), "s") for k in range(12_000)])
    labels = spark.range(12_000).selectExpr("id as doc_id", "cast(id % 3 > 0 as int) as quality")
    real = quality_ranking._summed
    seen = []
    monkeypatch.setattr(quality_ranking, "_summed", lambda rows, part: seen.append(rows.count()) or real(rows, part), raising=False)
    model = quality_ranking.learn(docs, labels)
    free = [k for k in range(12_000) if zlib.crc32(str(k).encode()) % 5]
    # over 4,000 rows a class: means, pairs and the cut all come from every one that may be learned from
    assert seen[0] == len(free) > 8_000 and min(seen) >= sum(k % 3 > 0 for k in free)
    got = {r["doc_id"]: r["s"] for r in quality_ranking.score(docs, model, name="s").select("doc_id", "s").collect()}
    assert all((got[k] > 0.3 + 1e-6) == (k % 3 > 0) for k in range(200))


def test_toxic_spans_point_at_words(spark):
    rows = [(k, f"nice day number w{k} you zzgrubel person" if k % 2 else f"nice day number w{k} you kind person", "s") for k in range(400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxic_spans.toxicity(docs, labels).collect()}
    for k, text, _ in rows:
        spans = [text[s["start"] : s["end"]] for s in got[k]["spans"]]
        assert spans == (["zzgrubel"] if k % 2 else [])
        assert got[k]["predicted"] == k % 2


@pytest.mark.parametrize("operator", [toxic_spans.toxicity, quality_ranking.quality])
def test_classifiers_on_odd_tables(spark, operator):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, [(1, None, None), (2, "", "s"), (2, "", "s"), (None, "word " * 20000, "s"), (4, "😀".encode("utf-16", "surrogatepass").decode("utf-16"), "s")])
    got = operator(docs.withColumn("score", F.lit("old")).withColumn("spans", F.lit("old")), labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert operator(documents(spark, []), labels).count() == 0
    some = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (2, None, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert operator(docs, some).count() == 5


def test_held_out_fold(spark):
    got = spark.range(50).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


# licences


def test_licences(spark):
    s = license_scan.SENTENCES
    mit = "\n".join(s[k] for k in ("mit.grant", "mit.notice-kept", "mit.as-is", "mit.liability"))
    wrapped = s["mit.grant"].replace(" a copy", "\na copy").replace(" without", "\n  without")
    rows = [
        (1, mit, "s"), (2, "Some words. Released under the MIT License. More words.", "s"), (3, None, "s"), (4, "", "s"),
        (5, wrapped + "\n\n" + s["mit.notice-kept"], "s"), (6, s["bsd.grant"] + "\n" + s["bsd.source"] + "\n" + s["bsd.binary"] + "\n" + s["bsd.as-is"], "s"),
        (7, "MIT", "s"), (8, s["gpl.hope"], "s"), (9, "Licensed under CC BY-SA 4.0. All rights reserved.", "s"), (9, "x", "s"),
    ]
    got = license_scan.scan(documents(spark, rows).withColumn("sids", F.lit(1))).collect()
    found = sorted((r["doc_id"], ",".join(r["licenses"])) for r in got)
    assert found == [(1, "MIT"), (2, "MIT"), (3, ""), (4, ""), (5, "MIT"), (6, "BSD-2-Clause"), (7, ""), (8, ""), (9, ""), (9, "CC-BY-SA-4.0,Proprietary")]
    assert license_scan.scan(documents(spark, [])).count() == 0


def test_licences_at_every_place(spark):
    s = license_scan.SENTENCES
    three = [s[f"bsd.{k}"] for k in ("grant", "source", "binary", "no-endorsement", "as-is")]
    two = three[:3] + three[4:]
    spread = s["bsd.grant"].replace(" ", " " * 40)
    wrapped = s["mit.grant"].replace(" a copy", "\na copy") + "\n\n" + s["mit.notice-kept"]
    texts = [
        "\n".join(three + two), "\n".join([three[0], s["reserved"], *two]), "\n".join([spread, *two[1:]]),
        "All rights reserved.\nSome words. All rights reserved. all  rights reserved", "\n***\nAll rights reserved.",
        wrapped + "\nWords.\n" + wrapped,
    ]
    rows = [(k, t, "s") for k, t in enumerate(texts)]
    got = {r["doc_id"]: (len(r["sids"]), ",".join(r["licenses"])) for r in license_scan.scan(documents(spark, rows + rows[:1])).collect()}
    assert got == {0: (9, "BSD-2-Clause,BSD-3-Clause"), 1: (6, "BSD-2-Clause,Proprietary"), 2: (4, "BSD-2-Clause"), 3: (3, "Proprietary"), 4: (1, "Proprietary"), 5: (4, "MIT")}


def brute_unnamed(norm):
    """The normal form with the known holder in the place of its own."""
    for before, behind, holder in license_scan.HOLDERS:
        a, b = license_scan.normal_form(before) + " ", " " + license_scan.normal_form(behind)
        if norm.startswith(a) and norm.endswith(b) and 0 < len(norm[len(a) : -len(b)].split()) <= license_scan.HOLDER_WORDS:
            return a + license_scan.normal_form(holder) + b
    return norm


def brute_notices(row, known):
    """Identifiers of the short notices in a line, word by word, the longest at a place."""
    short = {k: sid for k, sid in known.items() if ".named" in sid or sid.startswith("spdx.")}
    tag, words, out, i = ["spdx", "license", "identifier"], row.split(" "), [], 0
    if any(words[k : k + 3] == tag for k in range(len(words))):
        spread = []
        for k, w in enumerate(words):
            named = any(" ".join([*tag, *words[k:j]]) in short for j in range(k + 1, len(words) + 1))
            spread += [*tag, w] if named and k and words[k - 1] in ("or", "and") else [w]
        words = spread
    while i < len(words):
        ends = [j for j in range(len(words), i, -1) if " ".join(words[i:j]) in short]
        if ends:
            out.append(short[" ".join(words[i : ends[0]])])
        i = ends[0] if ends else i + 1
    return out


def brute_sentences(text):
    """Identifiers of known sentences in order of place, by a plain walk over the text."""
    known = {license_scan.normal_form(v): k for k, v in license_scan.SENTENCES.items()}
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").replace("\r\n", "\n")
    stripped = []
    for row in low.split("\n"):
        mark = re.match(r"[ \t]*(?:#|//|/?\*|--|;|%|<!--|\"|')+(?:[*/>-]*[ \t]+|$)", row)
        stripped.append(row[mark.end() :] if mark else row)
    pieces, here = [], []
    for row in stripped:
        blank = not row.strip(" \t")
        item = bool(re.match(r"[ \t]*(?:[*•-]|[(]?(?:[0-9]{1,2}|[a-z])[.)])[ \t]", row))
        if (blank or item) and here:
            pieces.append(here)
            here = []
        if not blank:
            words = re.split(r"(?<=[.!?])[ \t-\r]+", row)
            part = words[0]
            for nxt in words[1:]:
                if re.search(r"\b(?:v|vs|no|inc|ltd|corp|e\.g|i\.e)\.$", part):
                    part += " " + nxt
                else:
                    pieces.append(here + [part])
                    here, part = [], nxt
            here = here + [part]
            if re.search(r"[.!?][ \t]*$", part) and not re.search(r"\b(?:v|vs|no|inc|ltd|corp|e\.g|i\.e)\.[ \t]*$", part):
                pieces.append(here)
                here = []
    pieces.append(here)
    out = []
    for body in pieces:
        rows = [x for x in map(license_scan.normal_form, body) if x]
        n = len(rows)
        spans = {(i, i + 1) for i in range(n)} | {(0, k) for k in range(2, n + 1)} | {(n - k, n) for k in range(2, n + 1)}
        whole = {(i, j, known[k]) for i, j in spans if (k := brute_unnamed(" ".join(rows[i:j]))) in known}
        parts = {(i, sid) for i, row in enumerate(rows) if not any(a <= i < b for a, b, _ in whole) for sid in brute_notices(row, known)}
        out += sorted({(i, sid) for i, _, sid in whole} | parts)
    return [sid for _, sid in out]


def test_licence_sentences_equal_brute_force(spark):
    s, rng = license_scan.SENTENCES, random.Random(4)
    keys = list(s)
    texts = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    for _ in range(150):
        parts = []
        for key in rng.choices(keys, k=rng.randrange(1, 7)):
            body = s[key].replace("the copyright holder", rng.choice(["the copyright holder", "Foo Inc.", "The Regents of X", "word " * 30]))
            if rng.random() < 0.2:
                body = "Foo library - " + body.rstrip(".") + rng.choice([".", ", see LICENSE.", " or Apache-2.0", " AND GPL-2.0-or-later"])
            if rng.random() < 0.5:
                body = textwrap.fill(body, rng.choice([30, 60, 79]))
            parts.append(rng.choice(["Some words here\n", "Copyright 2020 A. B.\n", "", "1. ", "x "]) + body)
        text = rng.choice(["\n", "\n\n", " ", "\n  \n"]).join(parts)
        if rng.random() < 0.4:
            text = "\n".join(("# " + row).rstrip() for row in text.split("\n"))
        texts.append(text)
    got = {r["doc_id"]: r["sids"] for r in license_scan.scan(documents(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    want = {k: brute_sentences(t) for k, t in enumerate(texts)}
    assert sum(map(len, want.values())) > 300
    assert any("bsd.no-endorsement" in x for x in want.values())
    assert [(texts[k], got[k], want[k]) for k in want if got[k] != want[k]][:2] == []


APACHE = """# Copyright 2020 The Authors
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License.
"""


def test_licence_notices_as_they_stand_in_files(spark):
    s = license_scan.SENTENCES
    every = list(s.items())
    gpl = lambda first: "\n".join(textwrap.fill(s[k], 60) for k in (first, "gpl.hope", "gpl.details", "gpl.received"))
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at https://mozilla.org/MPL/2.0/. */"
    texts = [APACHE, APACHE.replace("#", "//"), mpl, "Released" + " " * 2000 + "under the MIT License.", gpl("gpl.free") + "\n\n" + gpl("gpl2.free"), "Words first. " * 4000 + "All rights reserved."]
    rows = [(k, t, "s") for k, t in enumerate(texts)] + [(100 + k, v, "s") for k, (_, v) in enumerate(every)]
    got = {r["doc_id"]: r for r in license_scan.scan(documents(spark, rows)).collect()}
    assert [",".join(got[k]["licenses"]) for k in range(6)] == ["Apache-2.0", "Apache-2.0", "MPL-2.0", "MIT", "GPL-2.0-or-later,GPL-3.0-or-later", "Proprietary"]
    assert got[0]["sids"] == ["apache2.header", "apache2.copy-at", "apache2.address", "apache2.as-is", "apache2.limits"]
    assert len(got[4]["sids"]) == 8
    for k, (sid, _) in enumerate(every):
        assert got[100 + k]["sids"] == [sid]
    with pytest.raises(ValueError):
        license_scan.known_sentences(spark, {"x": "One sentence. And another"})


def test_licences_with_holders_tags_and_notices_inside_lines(spark):
    s = license_scan.SENTENCES
    third = "Neither the name of Foo Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    author = "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission."
    as_is = s["bsd.as-is"].replace("THE COPYRIGHT HOLDERS AND CONTRIBUTORS", "FOO INC")
    bsd = lambda *clauses, end=as_is: "\n\n".join([s["bsd.grant"], "1. " + s["bsd.source"], "2. " + s["bsd.binary"], *clauses, textwrap.fill(end, 70)])
    cases = [
        (bsd(textwrap.fill("3. " + third, 60)), "BSD-3-Clause"), (bsd("3. " + author), "BSD-3-Clause"), (bsd(), "BSD-2-Clause"), (bsd("3. No one may use the logo."), "BSD"),
        (bsd("3. " + s["bsd.advertising"] + "\nThis product includes software developed by Foo.", "4. " + third), "BSD-4-Clause"),
        (bsd("3. All users must sing.", "4. " + third), "BSD"), ("Foo library - Licensed under the MIT License.", "MIT"), ("Licensed under the MIT licence.", "MIT"),
        ("/* SPDX-License-Identifier: MIT */\nint x;", "MIT"), ("// SPDX-License-Identifier: (MIT OR GPL-2.0-or-later)", "GPL-2.0-or-later,MIT"), ("# SPDX-License-Identifier: GPL-2.0-only", "GPL-2.0-only"),
        ("Code: licensed under the Apache License, Version 2.0, see LICENSE", "Apache-2.0"), (s["lgpl21.free"] + "\n" + s["lgpl.hope"] + " " + s["lgpl.details"], "LGPL-2.1-or-later"),
        ("unlicensed under the mit license", ""), ("Licensed under the MIT Licensed", ""), ("SPDX-License-Identifier: MIT\nparts licensed under CC BY 4.0 by X", "CC-BY-4.0,MIT"), ("SPDX-License-Identifier: MITX", ""),
    ]
    got = {r["doc_id"]: ",".join(r["licenses"]) for r in license_scan.scan(documents(spark, [(k, t, "s") for k, (t, _) in enumerate(cases)])).collect()}
    assert [got[k] for k in range(len(cases))] == [name for _, name in cases]


def test_licence_rules_take_their_sentences(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a", "c", "b"]), (3, []), (4, ["a", "b", "a", "b"])], "id long, sids array<string>")
    got = license_scan.match_rules(df, [("AB", ("a", "b")), ("A", ("a",)), ("B", ("b",))])
    assert {r["id"]: r["licenses"] for r in got.collect()} == {1: ["AB"], 2: ["A", "B"], 3: [], 4: ["AB"]}


# page text


def page(body):
    return f"<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>"


LONG = "This paragraph has a good many words so that it is the densest place of the whole page by far."


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("<html><body><nav><a href=x>Home</a></nav></body></html>", ""),
        (page(f"<nav><a>Home</a></nav><article><h1>Title &amp; more</h1><p>{LONG}</p><p>Second\n  one&#33; {LONG}</p></article><footer>c</footer>"), f"Title & more\n\n{LONG}\n\nSecond one! {LONG}"),
        (page(f"<div class='sidebar'><p>{LONG}</p></div><div class=content><p>{LONG} <a href=y>link</a> end</p><script>var a = '<p>';</script><div id=comments><p>nice</p></div></div>"), f"{LONG} link end"),
        (page(f"<main><p>{LONG}<p>unclosed {LONG}<ul><li>one<li>two</ul><!-- <p>hidden</p> --></main>"), f"{LONG}\n\nunclosed {LONG}\n\none\n\ntwo"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


PART = "<p>" + "word " * 79 + "last.</p>"
PART_TEXT = "word " * 79 + "last."


def lines(*blocks):
    return "\n\n".join(blocks)


@pytest.mark.parametrize("wrap", [page, lambda body: body])
def test_main_text_holds_the_whole_article(wrap):
    section = f"<section>{PART * 3}</section>"
    assert html_text.main_text(wrap(section + "<p>Short one.</p>" + section)) == lines(*[PART_TEXT] * 3, "Short one.", *[PART_TEXT] * 3)
    larger = f"<div>{PART * 9}</div>"
    assert html_text.main_text(wrap("<nav><a href=x>Home</a></nav>" + larger + section)) == lines(*[PART_TEXT] * 12)
    assert html_text.main_text(wrap(f"<h1>Head</h1><div>{PART * 3}</div>")) == lines("Head", *[PART_TEXT] * 3)
    assert html_text.main_text(wrap(f"<div>{PART * 3}</div><div class=sidebar>{PART}</div>")) == lines(*[PART_TEXT] * 3)


def test_main_text_drops_nothing_inside_an_article():
    links = "<a href=a>One long name of a source</a> and <a href=b>another long name of a source</a>"
    kept = "One long name of a source and another long name of a source"
    for tag in ("p", "div", "ul"):
        rich = f"<{tag}>{links}</{tag}>"
        assert html_text.main_text(page(f"<article>{PART * 3}{rich}</article>")) == lines(*[PART_TEXT] * 3, kept)
    menu = "<ul><li><a href=a>One</a><li><a href=b>Two</a></ul>"
    for tag in ("article", "div"):
        assert html_text.main_text(page(f"<{tag}>{PART * 3}{menu}</{tag}>")) == lines(*[PART_TEXT] * 3, "One", "Two")
    assert html_text.main_text(page(f"<div>{PART * 3}</div>{menu}<section>{PART * 3}</section>")) == lines(*[PART_TEXT] * 6)
    odd = "<p class=related>See also this.</p><section class='comments-policy'><p>Our rules.</p></section><p class='cookie-recipe'>Bake.</p>"
    assert html_text.main_text(page(f"<article>{PART * 3}{odd}</article>")) == lines(*[PART_TEXT] * 3, "See also this.", "Our rules.", "Bake.")


@pytest.mark.parametrize(
    "name", ["ad", "ad-slot", "site-nav", "top_menu", "cookie-banner", "user-comments", "comments-list", "side-bar right", "newsletter-box", "page-header", "header"]
)
def test_main_text_sets_named_boxes_aside(name):
    assert html_text.main_text(page(f"<div class='{name}'>{PART}</div><div>{PART * 3}<div class='{name}'>Words.</div></div>")) == lines(*[PART_TEXT] * 3)
    assert html_text.main_text(page(f"<div class=header><h1>Head</h1></div><div>{PART * 3}</div>")) == lines("Head", *[PART_TEXT] * 3)


@pytest.mark.parametrize(
    "page",
    [
        "<a " * 350_000, "<a \"" * 250_000 + ">", "<a '>" * 200_000, "<span>" * 80_000 + "<li>" * 80_000, "<li><ul>" + "<span>" * 60_000 + "<li></li>" * 60_000, "<b>" * 100_000 + "</i>" * 100_000, "<p>" + "<i>" * 100_000 + "<div>" * 60_000,
        "<!--" * 250_000, "<![" * 300_000, "<td><table>" * 60_000, "</p" * 300_000, "<" * 1_000_000, "<p>x</p>" * 60_000,
    ],
    ids=range(13),
)
def test_a_malformed_page_of_a_megabyte_takes_no_time(page):
    began = time.process_time()
    html_text.main_text("<article><p>kept</p></article>" + page)
    assert time.process_time() - began < 6


def test_broken_quotes_leave_no_markup():
    assert html_text.main_text("<article><p title='a\"b>bad</p><p>good</p></article>") == "bad\n\ngood"
    assert html_text.main_text("<article><p title=\"a>b\">one</p><p data-x='<i>'>two</p></article>") == "one\n\ntwo"
    assert "one" in html_text.main_text("<article><p>one</p><p title=\"never closed>two</p></article>")


@pytest.mark.parametrize("name", "article-comments discussion responses article-sidebar left-rail related related-posts recommended adsbygoogle ad-300x250 cookiebar author-bio".split())
def test_more_boxes_inside_an_article_are_set_aside(name):
    page = f"<article><p>{'The story goes on and on. ' * 8}</p><div class='{name}'><p>{'Not a part of it at all. ' * 4}</p></div></article>"
    assert html_text.main_text(page) == ("The story goes on and on. " * 8).strip()


def test_main_text_of_equal_densities_is_the_first_in_page_order():
    same = "<div><section><p>{0} one two three four five six seven eight.</p></section></div>"
    found = html_text.choose(html_text.parse(page(same.format("a") + "<footer>x</footer>")))
    again = html_text.choose(html_text.parse(page(same.format("a") + "<footer>x</footer>")))
    assert [n.tag for n in found if n] == [n.tag for n in again if n]
    tied = html_text.parse("<div>" + same.format("a") + same.format("b") + "</div>")
    order, _ = html_text.measure(tied)
    sums = [n.total for n in order if n.tag == "section"]
    assert len(sums) == 2 and sums[0] == sums[1]


def counted(node):
    """Characters, tags, link characters and link tags of a node, the plain way."""
    out = [0, 0, 0, 0]
    for part in node.parts:
        if isinstance(part, str):
            out[0] += len(part.strip())
        else:
            c = counted(part)
            own = [c[0], c[1] + 1, c[0] if part.tag == "a" else c[2], c[3] + (part.tag == "a")]
            out = [x + y for x, y in zip(out, own, strict=True)]
    return out


class Articles(HTMLParser):
    """Text blocks inside article elements, without adverts, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.depth, self.away, self.run, self.found = 0, 0, [], []

    def close_block(self):
        if text := " ".join("".join(self.run).split()):
            self.found.append(text)
        self.run = []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.away += tag in ("script", "style", "nav", "footer", "form", "aside")
        if tag == "br":
            self.run.append(" ")
        elif tag in html_text.BLOCK:
            self.close_block()

    def handle_endtag(self, tag):
        if tag in html_text.BLOCK:
            self.close_block()
        self.depth -= tag == "article"
        self.away -= tag in ("script", "style", "nav", "footer", "form", "aside")

    def handle_data(self, data):
        if self.depth and not self.away:
            self.run.append(data)


def test_main_text_of_the_pages(spark):
    rows = spark.read.parquet(f"{LARGER}/pages.parquet").select("html").collect()
    held = [(r["html"], Articles()) for r in rows if r["html"] and "<article" in r["html"]]
    right = 0
    for html, brute in held:
        brute.feed(html)
        brute.close_block()
        right += html_text.main_text(html) == lines(*brute.found)
    assert held and right == len(held)
    for html, _ in held[:50]:
        for node in html_text.measure(html_text.parse(html))[0]:
            assert counted(node) == [node.chars, node.tags, node.link_chars, node.link_tags]
            assert np.isclose(node.total, sum(p.density for p in node.parts if not isinstance(p, str)))


def test_page_query(spark):
    got = queries.op10_html_text(spark, SMALL).toPandas()
    assert len(got) == spark.read.parquet(f"{SMALL}/pages.parquet").count()
    assert (got["n_chars"] == got["text"].map(len)).all() and (got["n_chars"] > 0).mean() > 0.8
    assert not got["text"].str.contains(r"(?<!\n)\n(?!\n)|\n{3}|<p>|&amp;", regex=True).any()
    rows = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", "<p>" * 3000 + "x")], "page_id long, url string, html string")
    assert html_text.extract(rows.withColumn("text", F.lit("old"))).count() == 3
    assert html_text.extract(rows.limit(0)).count() == 0


# pipeline


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{LARGER}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontaminate", "mixture", "shards"]
    scores = {r["doc_id"]: r["score"] for r in queries.op5_quality_ranking(spark, LARGER).collect()}
    good = stages["quality"](spark, docs, LARGER)
    assert good.columns == columns
    rows = good.toPandas()
    assert set(rows["doc_id"]) == {i for i, s in scores.items() if s >= 0.3}
    good = spark.createDataFrame(rows, docs.schema)
    single = stages["near_duplicates"](spark, good, LARGER).toPandas()
    classes = brute_classes({int(i): brute_print(t) for i, t in zip(rows["doc_id"], rows["text"], strict=True)})
    assert list(single.columns) == columns and set(single["doc_id"]) == set(classes.values())
    clean = stages["decontaminate"](spark, spark.createDataFrame(single, docs.schema), LARGER).toPandas()
    bad = {r[0] for r in brute_contamination(list(zip(single["doc_id"], single["text"], strict=True)), items) if r[-1]}
    assert set(clean["doc_id"]) == set(single["doc_id"]) - bad
    mixed = stages["mixture"](spark, spark.createDataFrame(clean, docs.schema), LARGER)
    assert mixed.columns == columns
    mixed = mixed.toPandas()
    assert set(mixed["doc_id"]) <= set(clean["doc_id"]) and mixed.groupby("doc_id").size().max() <= 2
    placed = stages["shards"](spark, spark.createDataFrame(mixed, docs.schema), LARGER).toPandas()
    assert len(placed) == len(mixed)
    for _, own in placed.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
