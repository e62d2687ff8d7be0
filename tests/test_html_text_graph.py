import json
import random

from pyspark.sql import functions as F

from tabulon.functions import text
from tabulon.operators import graph
from tabulon.sources.html_tables import (best_tables, count_tables, html_tables, iter_tables, page_table_counts,
                                         table_frame)

TEAS = ("<html><body><p>intro<table><tr><th>Tea</th><th>Origin</th><th>Grams</th></tr>"
        "<tr><td>Sencha</td><td>Uji</td><td>40</td></tr>"
        "<tr><td>Assam</td><td>Jorhat</td><td>75</td></tr></table></body></html>")


def wiki_page():
    head = "<tr><th>Rank</th><th>Title</th><th>Worldwide gross</th><th>Year</th></tr>"
    body = "".join(f"<tr><td>{i}</td><td>Film {i}</td><td>${i},000</td><td>20{i:02d}</td></tr>"
                   for i in range(1, 13))
    small = "<table><tr><td>a</td><td>b</td></tr>" * 1 + "</table>"
    big = "<table>" + "".join(f"<tr><td>{i}</td></tr>" for i in range(40)) + "</table>"
    return f"<html>{small}{big}<table>{head}{body}</table></html>"


def test_html_tables_and_best(spark):
    pages = spark.createDataFrame([(1, "http://x.example/t.html", TEAS),
                                   (2, "https://en.wikipedia.org/wiki/Films", wiki_page()),
                                   (3, "http://y.example/", "<p>no tables</p>"),
                                   (4, "http://z.example/", "<table><tr><td>broken")],
                                  "page_id long, url string, html string")
    t = html_tables(pages)
    frame = table_frame(t, 1, 0).collect()
    assert [tuple(r) for r in frame] == [("Sencha", "Uji", "40"), ("Assam", "Jorhat", "75")]
    best = {r["page_id"]: r for r in best_tables(t, pages).collect()}
    assert best[2]["table_idx"] == 2 and best[2]["matched"]
    assert best[1]["table_idx"] == 0 and best[4]["n_rows"] == 1
    counts = {r["page_id"]: r["n_tables"] for r in page_table_counts(pages).collect()}
    assert counts == {1: 1, 2: 3, 3: 0, 4: 1}


def test_counted_tables_are_those_with_rows(spark):
    rng = random.Random(3)
    bits = ["<table>", "<TABLE class='a>b'>", "</table>", "</ table >", "<tr>", "<td x=\"<table><tr>\">", "</tr>", "<th/>",
            "<table/>", "<table border=1/>", "<table a=\"x=y\" />", "<!-- <table><tr> -->", "<!--x--  >", "text < 3 > 2", "<tbody>",
            "<script>if (a<b) '<table><tr>'</script>", "<style>x</STYLE >", "<p title='<table>'>", "<tablex><tr>", "</td>",
            "<!doctype html>", "<?php <table> ?>", "<a href=x>", "<br/>", "<table\n id = q>", "<trx>", "&lt;table>", "é"]
    pages = [("".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))),) for _ in range(1500)]
    pages += [("<script>var t = '<table><tr>'",), ("<table><tr><td><table><tr>" * 300,), ("",), (None,), ("<table><tr><td", )]
    for (page,) in pages:
        if page is not None:
            assert count_tables(page) == len({t for t, *_ in iter_tables(page)}), page
    df = spark.createDataFrame([(i, p) for i, (p,) in enumerate(pages)] * 2, "page_id long, html string")
    got = page_table_counts(df)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInPandas" not in plan
    assert sorted((r.page_id, r.n_tables) for r in got.collect()) == sorted(
        (i, count_tables(p or "")) for i, (p,) in enumerate(pages) for _ in range(2))


def test_prompt_mining(spark):
    q = ("Scrape https://en.wikipedia.org/wiki/List_of_films and answer:\n"
         "1. How many $2 bn movies were released before 2000?\n"
         "2. Which is the earliest film that grossed over $1.5 bn?\n"
         "Return a JSON object with keys:\n- `count`: number\n- `film`: string\n"
         "see also https://en.wikipedia.org/wiki/List_of_films")
    df = spark.createDataFrame([(1, q), (2, "  just one question  ")], "id int, text string")
    urls = text.extract_urls(df, "id", "text").collect()
    assert [r["url"] for r in urls] == ["https://en.wikipedia.org/wiki/List_of_films"]
    qs = {(r["id"], r["pos"]): r["question"] for r in text.extract_questions(df, "id", "text").collect()}
    assert qs[(1, 0)] == "How many $2 bn movies were released before 2000?"
    assert qs[(2, 0)] == "just one question"
    shape = {r["id"]: r for r in text.answer_shape(df, "id", "text").collect()}
    assert shape[1]["json_object"] and shape[1]["keys"] == ["count", "film"]
    assert shape[2]["format"] == "standard" and not shape[2]["json_object"]
    obj = df.where("id = 1").select(text.answers_object(
        text.json_keys("text"), F.array(F.lit("7")))).first()[0]
    assert json.loads(obj) == {"count": "7", "film": None}


# a square with one diagonal and a tail
EDGES = [("n1", "n2"), ("n2", "n3"), ("n3", "n4"), ("n4", "n1"), ("n1", "n3"), ("n4", "n5"), ("n5", "n6")]


def test_graph(spark):
    e = spark.createDataFrame(EDGES + [("n2", "n1")], "source string, target string")
    deg = {r["node"]: r["degree"] for r in graph.degrees(e).collect()}
    assert deg == {"n1": 3, "n2": 2, "n3": 3, "n4": 3, "n5": 2, "n6": 1}
    s = graph.graph_summary(e).first()
    assert s["n_edges"] == 7 and abs(s["density"] - 14 / 30) < 1e-12
    assert abs(s["average_degree"] - 14 / 6) < 1e-12 and s["max_degree_node"] == "n1"
    path = [r["node"] for r in graph.shortest_path(e, "n2", "n6").orderBy("step").collect()]
    assert path == ["n2", "n1", "n4", "n5", "n6"]
    assert graph.shortest_path(e, "n2", "n6", max_depth=3).count() == 0
    assert graph.shortest_path(e, "n2", "nowhere").count() == 0
    assert [tuple(r) for r in graph.shortest_path(e, "n2", "n2").collect()] == [(0, "n2")]
    hist = {r["degree"]: r["nodes"] for r in graph.degree_histogram(e).collect()}
    assert hist == {1: 1, 2: 2, 3: 3}


def test_html_spans_and_faults(spark, monkeypatch):
    from tabulon.sources import html_tables as ht
    cells = lambda html: [c for _, _, _, c in ht.parse_tables(html)]
    assert cells("<table><tr><td>A</td><td rowspan=2>B</td></tr><tr></tr><tr><td>C</td><td>D</td></tr></table>") \
        == [["A", "B"], [None, "B"], ["C", "D"]]
    assert cells("<table><tr><td>a<td>b<td rowspan=3>c<tr><td>x<tr><td>y<td>z</table>") \
        == [["a", "b", "c"], ["x", None, "c"], ["y", "z", "c"]]
    long = "<table><tr><td rowspan=1500>A</td><td>0</td></tr>" + "<tr><td>i</td></tr>" * 1500 + "</table>"
    got = cells(long)
    assert got[1499] == ["A", "i"] and got[1500] == ["i"]
    assert cells("<table><thead><tr><th rowspan=0>H<th>x<tr><th>y</thead><tr><td>1</table>") \
        == [["H", "x"], ["H", "y"], ["1"]]
    monkeypatch.setattr(ht, "iter_tables", lambda html: (_ for _ in ()).throw(RuntimeError("broken")))
    import pandas as pd
    rows = pd.concat(ht._parse_batches([pd.DataFrame({"page_id": [7], "html": ["<table>"]})]))
    assert rows["page_id"].tolist() == [7] and "broken" in rows["error"].iloc[0]
