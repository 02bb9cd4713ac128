"""Small literal cases of the operators, and what holds without the optional package."""

import os
import subprocess
import sys
import time

import pytest
from conftest import ROOT
from pyspark.sql import functions as F

from sievework.functions import html as H
from sievework.functions import text as T
from sievework.operators import charts, dom, extract, quantiles, ranking, replay, vectors
from sievework.plans import providers
from sievework.sources import saved, store


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_tokens(spark):
    assert one(spark, T.tokens(F.lit("Hello, World! café test 123 abc456 789"))) == ["hello", "world", "café", "test", "abc456"]
    assert one(spark, T.tokens(F.lit(""))) == []


def test_sentences_protect_abbreviations(spark):
    got = one(spark, T.raw_sentences(F.lit("We met Dr. Smith there. He left.\nNew line")))
    assert got == ["We met dr. Smith there.", "He left.", "New line"]
    assert one(spark, T.raw_sentences(F.lit(""))) == []


def test_chunks_overlap(spark):
    s = F.array(*(F.lit(x) for x in ("a" * 20, "b" * 20, "c" * 20)))
    assert one(spark, T.chunks(s, 45, 25)) == ["a" * 20 + " " + "b" * 20, "b" * 20 + " " + "c" * 20]
    assert one(spark, T.chunks(F.array().cast("array<string>"), 45, 25)) == []


def test_strip_tags_keeps_references(spark):
    assert one(spark, T.strip_tags(F.lit("<p>a &amp;  b</p>"))) == "a &amp; b"
    assert one(spark, T.strip_tags(F.lit(None).cast("string"))) == ""


def test_bm25_prefers_matching_and_keeps_all(spark):
    docs = spark.createDataFrame([(1, "java code"), (2, "python programming python"), (3, "cooking")], "id long, text string")
    q = spark.createDataFrame([("python programming",)], "query string")
    rows = {r["id"]: r["score"] for r in ranking.bm25(docs, "id", "text", q).collect()}
    assert rows[2] > 0 and rows[1] == 0 and rows[3] == 0


def test_dedup_results(spark):
    rows = [(0, "http://a/", 1.0), (1, "http://a", 2.0), (2, None, 5.0), (3, "", 5.0), (4, "http://b", None)]
    got = {(r["rid"], r["position"]) for r in ranking.dedup_results(spark.createDataFrame(rows, "rid long, url string, score double")).collect()}
    assert got == {(1, 0), (4, 4)}


def test_diverse_total_zero_keeps_one(spark):
    df = spark.createDataFrame([(k, "s", 1.0) for k in range(5)], "o int, src string, score double")
    assert ranking.diverse_select(df, "src", "score", "o", 3, 0).count() == 1
    assert [r["adjusted"] for r in ranking.diverse_select(df, "src", "score", "o").orderBy("o").collect()] == [1.0, 0.75, 0.5]


def test_rate_limiter_counts_admitted_only():
    step = replay.rate_limiter(2, 10)()
    assert [step(t) for t in (0, 1, 2, 9, 10, 10.5, 11)] == [True, True, False, False, True, False, True]


def test_lru_cache_evicts_and_expires():
    step = replay.lru_cache(2, 5)()
    ops = [("set", "a", 0), ("set", "b", 1), ("get", "a", 2), ("set", "c", 3), ("get", "b", 3), ("get", "a", 4), ("get", "a", 6)]
    assert [step(o, k, t) for o, k, t in ops] == [None, None, True, None, False, True, False]


def test_lru_cache_deletes_and_counts():
    cache = replay.LruCache(2, 5)
    cache.set("a", 0)
    cache.set("a", 3)  # an update is no second entry
    assert cache.stats() == {"size": 1, "max_size": 2} and cache.get("a", 8) and not cache.get("a", 9)
    assert not cache.delete("a")
    cache.set("b", 9)
    assert cache.delete("b") and not cache.delete("b") and cache.stats()["size"] == 0


def test_nearest_within_groups(spark, monkeypatch):
    rows = [(k, "g" if k % 3 else "h", [float(k % 7), float(k % 5), 1.0]) for k in range(60)]
    v = spark.createDataFrame(rows, "id long, grp string, v array<double>")
    q = v.where("id % 10 = 0").select("grp", F.col("id").alias("qid"), F.col("v").alias("q"))
    find = lambda: sorted((r["qid"], r["rank"], r["id"], r["sim"]) for r in vectors.nearest_within(v, q, "grp", "id", "qid", 4).collect())
    first = find()
    monkeypatch.setattr(vectors, "BROADCAST_QUERIES", 0)  # beyond the broadcast: dealt by salts
    assert find() == first and len(first) == 24


def test_nearest_within_compares_by_matrix_products(spark):
    odd = [None, [0.0, 0.0, 0.0], [1.0, 2.0], [1.0, None, 2.0]]
    rows = [(k, None if k % 17 == 0 else k % 2, odd[k % 11] if k % 11 < 4 else [float(k % 7), float(k % 5), 1.0]) for k in range(90)]
    v = spark.createDataFrame(rows, "id long, grp int, v array<double>")
    q = v.where("id % 5 = 0").select("grp", F.col("id").alias("qid"), F.col("v").alias("q"))
    plain = F.expr("size(v) = size(q) and not exists(v, x -> x is null) and not exists(q, x -> x is null)")
    sim = F.when(plain, F.round(vectors.cosine(F.col("v"), F.col("q")), 4))  # what can't be compared has none, as in SQL
    each = v.join(q, "grp").where("id <> qid").select("qid", "id", sim.alias("sim")).collect()
    found = vectors.nearest_within(v, q, "grp", "id", "qid", 6)
    for most in (6, 60):
        got = sorted((r["qid"], r["rank"], r["id"], r["sim"]) for r in vectors.nearest_within(v, q, "grp", "id", "qid", most).collect())
        want = []
        for one in sorted({r["qid"] for r in each}):
            best = sorted((r for r in each if r["qid"] == one), key=lambda r: (r["sim"] is None, -(r["sim"] or 0), r["id"]))[:most]
            want += [(one, k + 1, r["id"], r["sim"]) for k, r in enumerate(best)]
        assert got == want
    assert "zip_with" not in found._jdf.queryExecution().toString()  # before: an expression for each pair


def test_greedy_independent(spark):
    nodes = spark.range(6).withColumnRenamed("id", "k")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (4, 5)], "a long, b long")
    assert sorted(r["k"] for r in vectors.greedy_independent(nodes, edges, "k").collect()) == [0, 2, 4]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><h2>Head</h2><p>Text</p><script>x</script></body></html>"
    assert one(spark, H.clean_html(F.lit(page))) == "t\n## Head\nText"
    assert one(spark, H.title_of(F.lit(page))) == "t"


def test_saved_search(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"query": "q", "results": [{"title": "T", "url": "u", "content": "<b>c</b>", "score": 1}, 5]}')
    (tmp_path / "b.json").write_text("not json")
    spark.dataSource.register(saved.SavedSearch)
    for path in (f"{tmp_path}/*.json", f"file://{tmp_path}/a.json", str(tmp_path)):
        got = spark.read.format("saved_search").option("path", path).load().collect()
        assert [(r["query"], r["title"], r["score"]) for r in got] == [("q", "T", 1.0), ("q", "", None)]
    assert spark.read.format("saved_search").option("path", f"{tmp_path}/none/*.json").load().count() == 0
    again = saved.search_results(spark, f"{tmp_path}/*.json").orderBy("rid").collect()
    assert [(r["rid"], r["title"], r["snippet"], r["score"]) for r in again] == [(0, "T", "c", 1.0), (1, "", "", None)]


def test_providers_responses():
    brave = '{"web": {"results": [' + ",".join('{"title": "t", "url": "u", "description": "d", "page_age": "2024"}' for _ in range(25)) + "]}}"
    assert len(list(saved.result_rows(brave, "brave"))) == 20 and next(saved.result_rows(brave, "brave"))[2:6] == ("t", "u", "d", "2024")
    assert saved.brave_params("q", 50, "Week") == {"q": "q", "count": 20, "freshness": "PW"} and saved.brave_params("q", 5, "2024-01to") == {"q": "q", "count": 5, "freshness": "2024-01to"} and saved.brave_params("q") == {"q": "q", "count": 20}
    assert saved.wiki_rows('{"results": [{"title": "T", "path": "p", "snippet": "s"}]}', "search") == [{"title": "T", "url": "p", "content": "s", "score": 0, "zim": ""}]
    assert saved.wiki_rows('{"book": [{"title": "T", "path": "p"}]}', "suggest", "book") == [{"title": "T", "url": "p"}] and saved.wiki_rows('{"other": []}', "suggest", "book") == []
    assert saved.wiki_rows('[{"name": "n", "entries": 3}]', "catalog")[0]["entries"] == 3 and saved.wiki_rows('{"name": "n"}', "catalog") == []
    assert saved.wiki_rows('{"content": "c"}', "content") == [{"content": "c"}] and saved.wiki_rows("{}", "random") == [] and saved.wiki_rows(None, "search") == []


def test_saved_pages_and_documents(spark, tmp_path):
    (tmp_path / "p.html").write_text('<article class="result"><h3><a href="http://a/">title</a></h3></article>')
    (tmp_path / "q.html").write_text("Too Many Requests")
    got = saved.result_pages(spark, f"{tmp_path}/*.html", "searx").collect()
    assert [(r["rid"], r["url"], r["title"]) for r in got] == [(0, "http://a/", "title")]
    files = spark.createDataFrame([("a", bytearray(b"one\x01\f \ftwo")), ("b", None), ("c", bytearray(b"\f"))], "url string, content binary")
    assert [(r["url"], r["page"], r["text"]) for r in saved.document_pages(files).orderBy("page").collect()] == [("a", 1, "one"), ("a", 3, "two")]
    assert [(r["url"], r["text"]) for r in saved.document_texts(files).collect()] == [("a", "one\n\ntwo")]
    assert saved.document_pages(files, lambda content: 1 / 0).count() == 0


def test_selectors():
    page = "<div id=a class='x y'><h2 data-k='one two'>T &amp; U</h2><p>1</p><p class=z>2<b>3</b></div><ul><li>i<li class=last>j</ul><br><p>4"
    got = lambda s: [dom.text_of(n) for n in dom.select(dom.parse(page), s)]
    assert got("h2") == ["T & U"] and got("#a > p") == ["1", "23"] and got("div.x.y h2[data-k~=two]") == ["T & U"]
    assert got("li") == ["i", "j"] and got("li:last-child") == ["j"] and got("li + li") == ["j"] and got("div ~ p") == ["4"]
    assert got("h2, b") == ["T & U", "3"] and got("[data-k^=one]") == got("[data-k$='two']") == got('[data-k*="e t"]') == ["T & U"] and got("*.last") == ["j"]
    assert got("h2 > b") == [] and dom.text_of(dom.parse("<p>x</i></p></div>y")) == "xy" and dom.parse(None).elements == []
    for bad in ("", "p >", "p[", "!"):
        with pytest.raises(dom.SelectorError):
            list(dom.select(dom.parse(page), bad))
    deep = dom.parse("<div>" * 3000 + "x")
    assert dom.text_of(deep) == "x" and len(list(deep.walk())) == 3000


def test_selectors_extract_fields():
    page = "<h1>T</h1><span class=by>Ann</span><main>a<script>no</script><p>b</p></main>"
    assert extract.Selectors(author=".byline, .by").extract(page) == {"title": "T", "author": "Ann", "date": None, "text": "a b"}
    assert extract.Selectors().extract(None) == {"title": None, "author": None, "date": None, "text": ""}
    assert extract.select_text("<p class='u'>x <i>y</p>", "p.u") == "x y" and extract.select_text("", "p") == ""


def test_result_pages():
    searx = (
        '<article class="result result-default"><a class="url_header" href="http://a/"></a><h3><a href="http://other/">A <b>one</b> &amp; two</a></h3><p class="result-content">about <b>a</b></p></article>'
        '<article class="result"><h3><a href="http://b/">B</a></h3></article><article class="result"><h3>no link</h3></article><article><h3><a href="http://c/">no result</a></h3></article>'
    )
    assert extract.result_rows(searx) == [{"url": "http://a/", "title": "A one &amp; two", "snippet": "about a"}, {"url": "http://b/", "title": "B", "snippet": ""}]
    ddg = (
        '<div class="result"><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fx.example%2F%3Fa%3D1&rut=2">X</a><a class="result__snippet">sx</a></div>'
        '<div class="result"><a class="result__a" href="//y.example/">Y</a></div><div class="result"><a class="result__a" href="https://duckduckgo.com/y.js?ad_domain=z">Ad</a></div>'
    )
    assert [(r["url"], r["title"], r["snippet"]) for r in extract.result_rows(ddg, "duckduckgo")] == [("https://x.example/?a=1", "X", "sx"), ("https://y.example/", "Y", "")]
    links = '<a href="http://a.example/">first title</a><a href="http://a.example/">again the same</a><a href="http://b.example/">abc</a><a href="/rel">relative link</a><a href="http://c.example/?page=2">next page</a><a href="http://d.example/"><b>inner</b></a>'
    assert extract.link_rows(links) == [{"url": "http://a.example/", "title": "first title", "snippet": ""}]
    assert extract.search_page(links, "searx") == extract.link_rows(links) and extract.search_page(searx, "searx", 1) == extract.result_rows(searx)[:1] and extract.search_page(None, "searx") == []


def test_the_number_of_a_refusal_in_results_is_none():
    page = '<article class="result"><h3><a href="http://a/de/4290">room 429</a></h3><p class="result-content">about <b>429</b></p></article><script>track(429)</script><!-- ad 429 -->'
    assert extract.search_page(page, "searx") == [{"url": "http://a/de/4290", "title": "room 429", "snippet": "about 429"}]
    for said in ("<p>429 Too Many Requests</p>", "<p>Rate limit exceeded</p>", "<title> 429 </title>", "<h1>Error 429</h1>", "HTTP 429", "status: 429", "<p>429</p>"):
        assert extract.search_page(said + page, "searx") == []
    assert extract.search_page("429", "searx") == []


def test_references_are_kept_as_they_stand():
    page = lambda title: f'<article class="result"><h3><a href="http://a/?x=1&amp;y=2">{title}</a></h3></article>'
    for title in ("one &amp; two", "one&amp", "one &am", "one &", "a&b;c", "&#38", "&# one", "&#x; one", "&; \ue000 &lt;"):
        row = {"url": "http://a/?x=1&y=2", "title": title, "snippet": ""}
        assert extract.result_rows(page(title) + page("next")) == [row, row | {"title": "next"}]
    # decoded once, if they end with a semicolon
    assert extract.select_text("<h1>1 &lt; 2 &amp;lt; &#x27;&#39;&nosuch;&notit; &amp</h1>", "h1") == "1 < 2 &lt; ''&nosuch;&notit; &amp"
    assert extract.select_text("<p>a &# b</p><h1>c</h1>", "h1") == "c"


def test_charts(spark):
    make = lambda kind, data, **more: charts.figure(charts.Chart(kind, data, **more))
    assert make("line", {"y": [1, 2]})["data"] == [{"type": "scatter", "mode": "lines+markers", "x": [0, 1], "y": [1, 2]}]
    assert [(t["name"], t["y"]) for t in make("bar", {"labels": ["a"], "values": [[1], [2]], "names": ["u", "v"]})["data"]] == [("u", [1]), ("v", [2])]
    assert [t["x"] for t in make("scatter", {"x": [[1], [2]], "y": [[3], [4]]})["data"]] == [[1], [2]] and make("area", {"y": [[1], [2]]})["data"][1]["name"] == "Series 2"
    assert make("pie", {"names": ["a"], "y": [1]})["data"][0] == {"type": "pie", "labels": ["a"], "values": [1]} and make("histogram", {"values": [1]})["data"][0]["nbinsx"] == 10
    assert [t["name"] for t in make("box", {"y": [[1], [2]]})["data"]] == ["Group 1", "Group 2"] and make("box", {"y": [1]})["data"] == [{"type": "box", "y": [1]}]
    assert make("heatmap", {"matrix": [[1]], "x_labels": ["a"]})["data"][0] == {"type": "heatmap", "z": [[1]], "x": ["a"]}
    assert make("treemap", {"labels": ["a", "b"], "values": [1, 2]})["data"][0]["parents"] == ["", ""] and make("sunburst", {"names": ["a"], "parents": ["r"]})["data"][0]["parents"] == ["r"]
    assert make("funnel", {"stages": ["s"], "values": [3]})["data"][0] == {"type": "funnel", "y": ["s"], "x": [3]}
    gauge = make("gauge", {"value": 5, "max": 10, "thresholds": {}})["data"][0]["gauge"]
    assert gauge["threshold"]["value"] == 9 and [b["range"] for b in gauge["steps"]] == [[0, 5], [5, 8]] and make("gauge", {"value": 5})["data"][0]["gauge"]["steps"] == []
    assert make("indicator", {"value": 5, "delta": 3})["data"][0]["delta"] == {"reference": 3} and make("bubble", {"x": [1], "y": [2]})["data"][0]["marker"]["size"] == [20]
    whole = make("bar", {"x": ["a"], "y": [1]}, title="T", x_label="X", y_label="Y", options={"width": 3, "show_legend": False, "colors": ["red", "blue"]})
    assert whole["layout"] == {"title": {"text": "T"}, "xaxis": {"title": {"text": "X"}}, "yaxis": {"title": {"text": "Y"}}, "width": 3, "showlegend": False} and whole["data"][0]["marker"]["color"] == "red"
    assert make("line", {})["data"][0]["y"] == [] and make("pie", {})["data"][0]["labels"] == []
    for bad in (("spiral", {}), ("line", {"y": 5}), ("bar", {"y": [[1], [2]], "names": ["one"]})):
        with pytest.raises(charts.ChartError):
            make(*bad)
    assert "<\\/script>" in charts.page(charts.Chart("pie", {"labels": ["</script>"]})) and len(charts.TYPES) == 14
    df = spark.createDataFrame([("b", 2), ("a", 1)], "k string, v long")
    assert make("bar", charts.columns_of(df, x="k", y="v"))["data"][0]["x"] == ["a", "b"]
    with pytest.raises(charts.ChartError):
        charts.columns_of(df, 1, x="k")


def test_eviction(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.evict(spark, path, 0.0) == 0 and store.stats(spark, path, 0.0, 9) == {"size": 0, "expired": 0, "max_size": 9}
    for k, (ttl, now) in enumerate([(10, 0), (0, 1), (0, 2), (0, 2), (5, 3)]):
        store.append(store.store_rows(spark.createDataFrame([(f"t{k}",)], "c string"), "c", "text", float(now), float(ttl)), path)
    assert store.stats(spark, path, 9.0, 3) == {"size": 5, "expired": 1, "max_size": 3}
    assert store.evict(spark, path, 9.0, 2) == 3  # the expired one, then the oldest
    left = {r["content"] for r in store.live(spark, path, 9.0).collect()}
    assert len(left) == 2 and "t4" not in left and "t1" not in left
    store.append(store.store_rows(spark.createDataFrame([("new",)], "c string"), "c", "text", 9.0, 1.0), path)
    ids = spark.createDataFrame([("missing",)], "id string").unionByName(store.entries(spark, path).select("id"))
    assert store.lookup(spark, path, ids, 10.0).where("content is not null").count() == 3
    stream = store.evict_periodically(spark, path, lambda: 100.0, every="1 second")
    try:
        deadline = time.time() + 60
        while store.stats(spark, path, 100.0, 9)["size"] > 2 and time.time() < deadline:
            time.sleep(1)
    finally:
        stream.stop()
    assert store.stats(spark, path, 100.0, 9) == {"size": 2, "expired": 0, "max_size": 9}


def test_query_providers(spark):
    fail = lambda messages: 1 / 0
    variants = ["first", "second", "third"]
    assert providers.search_variants([*variants, "never"], lambda v: fail(v) if v == "second" else [{"v": v}]) == [{"v": "first"}, {"v": variants[2]}]
    chat = [{"role": "user", "content": "Birds fly. Cats and dogs sleep a lot. Cats sleep, dogs sleep."}]
    assert providers.streamed_text([": ping", "data: broken", *providers.chat_stream(chat)]) == providers.extractive_chat(chat) == "Cats and dogs sleep a lot."
    scores = [("a", 0.9), ("b", 0.8), ("c", 0.7), ("d", 0.6), ("e", 0.4)]
    assert providers.choose_instances(scores) == ["a", "b", "c"] and {u for k in range(40) for u in providers.choose_instances(scores, explore=1.0, seed=k)} == {"a", "b", "c", "d"}
    df = spark.createDataFrame([(1, "red fox", t, k) for k, t in enumerate(["none", "a red fox", "fox", "red fox late"])], "q long, query string, text string, n long")
    got = [(r["rank"], r["text"], r["score"]) for r in providers.rerank(df, "q", "query", "text", "n", 2).orderBy("rank").collect()]
    assert got == [(1, "a red fox", 10.0), (2, "red fox late", 10.0)]
    assert [r["text"] for r in providers.rerank(df, "q", "query", "text", "n", 1).collect()] == ["a red fox"]  # the first two were candidates


def test_ranking_with_many_queries(spark):
    docs = spark.createDataFrame([(1, "java code"), (2, "python programming python"), (3, "cooking python"), (4, None)], "id long, text string")
    asked = spark.createDataFrame([(10, "python programming"), (11, "java java"), (12, "nothing"), (13, "")], "qid long, query string")
    scores = {(r["qid"], r["id"]): r["score"] for r in ranking.bm25_scores(docs, "id", "text", asked, "qid").collect()}
    assert set(scores) == {(10, 2), (10, 3), (11, 1)} and scores[10, 2] > scores[10, 3]
    alone = {r["id"]: r["score"] for r in ranking.bm25(docs, "id", "text", asked.where("qid = 11").select("query")).collect()}
    assert abs(alone[1] - scores[11, 1]) < 1e-9 and alone[4] == 0
    top = ranking.top_of_query(ranking.bm25_scores(docs, "id", "text", asked, "qid"), "qid", "id", 1)
    assert {(r["qid"], r["id"]) for r in top.collect()} == {(10, 2), (11, 1)}
    rows = spark.createDataFrame([(1, ["red fox", "blue sky", "fox fox"], [("fox", 1)]), (2, [], [("fox", 1)]), (3, ["x"], []), (4, ["12 34"], [("fox", 1)])], "id long, c array<string>, terms array<struct<term:string,times:bigint>>")
    best = ranking.best_passages(rows, "c", "terms", 2).collect()
    assert [(r["id"], r["rank"], r["pos"]) for r in best] == [(1, 1, 2), (1, 2, 0), (3, 1, 0), (4, 1, 0)] and best[2]["score"] == 0


def test_exact_quantiles(spark):
    values = {"a": [3.0, 1.0, 2.0, 2.0, None], "b": [5.0], "c": [None], "d": [float(x * x % 17) for x in range(50)]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, "g", F.col("v"), {"lo": 0.0, "q": 0.25, "m": 0.5, "hi": 1.0}).collect()}
    assert set(got) == {"a", "b", "d"}
    for g, r in got.items():
        vs = sorted(v for v in values[g] if v is not None)
        for name, share in (("lo", 0.0), ("q", 0.25), ("m", 0.5), ("hi", 1.0)):
            place = share * (len(vs) - 1)
            low, high = vs[int(place)], vs[-int(-place // 1)]
            assert abs(r[name] - (low + (high - low) * (place - int(place)))) < 1e-12


def test_merge_short(spark):
    words = lambda n: " ".join("w" * n)
    for given, want in (([], []), (["a b"], ["a b"]), (["a", "b c", words(5), "d", words(6)], ["a b c", words(5) + " d", words(6)])):
        column = F.array(*(F.lit(x) for x in given)) if given else F.array().cast("array<string>")
        assert one(spark, T.merge_short(column)) == want


def test_store(spark, tmp_path):
    df = spark.createDataFrame([("x",), ("y",)], "c string")
    store.append(store.store_rows(df, "c", "text", 100.0, 10.0), str(tmp_path / "s"))
    store.append(store.store_rows(df.where("c = 'x'"), "c", "text", 200.0, 0), str(tmp_path / "s"))
    assert [r["content"] for r in store.live(spark, str(tmp_path / "s"), 150.0).collect()] == ["x"]
    assert store.live(spark, str(tmp_path / "s"), 105.0).count() == 2


def test_providers(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "k long, t string")
    got = {r["k"]: r["embedding"] for r in providers.embed(df, "k", "t").collect()}
    assert sum(got[1]) == 3 and sum(got[2]) == 0
    assert one(spark, providers.overlap_scorer(F.lit("red fox"), F.lit("a fox"))) == 5.0
    assert len(one(spark, providers.sentence_facts(F.lit("A first long sentence. B is another one.")))) == 2


def test_library_works_without_optional_package():
    code = (
        "import sys\n"
        "class Block:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('sievework.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Block())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'page_query_topk' in names and not any(n.startswith('op') and n[2].isdigit() for n in names) and 'pipeline' not in names\n"
        "assert set(e.oracle_sql()) <= set(names)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, check=True, timeout=120)
