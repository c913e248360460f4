"""Facts, keys, mappings, reports, sources, pages and fetch logs on small tables."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from blendspark.operators import facts as FO
from blendspark.operators import lineage as LN
from blendspark.operators import mapping as MP
from blendspark.operators import matching as MT
from blendspark.operators import matrix as M
from blendspark.operators import pages as P
from blendspark.operators import reports as R
from blendspark.plans import inputs
from blendspark.sources import readers, writers


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def test_usage_counts(spark):
    ingredients = spark.createDataFrame([(1, "gin"), (2, "vermouth")], "ingredient_id long, ingredient_name string")
    recipes = spark.createDataFrame([(101, "B"), (102, "A, with comma"), (103, "C")], "recipe_id long, recipe_name string")
    uses = spark.createDataFrame([(101, 1), (101, 2), (102, 1), (103, 1), (103, 1)], "recipe_id long, ingredient_id long")
    two = R.ingredient_usage(uses, ingredients, recipes, 2).collect()
    assert [(r["ingredient_name"], r["recipe_count"], r["sample_recipes"]) for r in two] == [("gin", 3, ["A, with comma", "B", "C"])]
    assert [r["recipe_count"] for r in R.ingredient_usage(uses, ingredients, recipes).collect()] == [3, 1]


def test_dense_index_and_prefix_sum(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x int").repartition(5)
    got = {r["x"]: r["idx"] for r in LN.dense_index(df, "x").collect()}
    assert got == {i: i for i in range(101)}
    sums = {r["x"]: r["s"] for r in LN.prefix_sum(df, "x", "x", "s").collect()}
    assert sums == {i: i * (i - 1) // 2 for i in range(101)}
    assert LN.quantile(df, "x", 0.5) == 50 and LN.quantile(df, "x", 0.255) == pytest.approx(25.5)
    assert LN.quantile(df.where("x < 0"), "x", 0.5) is None


def test_ids_follow_the_highest(spark):
    known = spark.createDataFrame([(3, "gin"), (9, "rum")], "id long, name string")
    names = spark.createDataFrame([("rye",), ("gin",), ("ale",), ("rye",), (None,)], "name string")
    assert rows(FO.assign_ingredient_ids(names, known)) == [(10, "ale"), (11, "rye"), (3, "gin"), (9, "rum")]


def test_matrix_drops_zero_rows(spark):
    facts = spark.createDataFrame(
        [(1, 5, 2.0, 30.0), (1, 6, None, None), (1, 5, 1.0, None), (2, 5, 0.0, 30.0)],
        "recipe_id long, ingredient_id long, amount double, conversion_to_ml double",
    )
    got = {(r["recipe_id"], r["ingredient_id"]): r["w"] for r in M.recipe_matrix(facts).collect()}
    assert got == {(1, 5): pytest.approx(61 / 62), (1, 6): pytest.approx(1 / 62)}


def test_mapping_flow(spark):
    names = spark.createDataFrame([("Lemon Juice",), ("fresh lemon juice",), ("gin",), ("rye",)], "name string")
    mapping = spark.createDataFrame([("gin", 1, "Gin")], "name string, mapped_id long, mapped_name string")
    none = spark.createDataFrame([], "name string")
    catalogue = spark.createDataFrame(
        [(7, "lemon juice", "/7/"), (8, "Lemon Juice", "/8/"), (9, "rye", "/9/")], "id long, name string, path string"
    )
    assert rows(MP.unmapped_names(names, mapping, none), "name") == [("Lemon Juice",), ("fresh lemon juice",), ("rye",)]
    auto = rows(MT.auto_match_exact(names, mapping, catalogue), "name", "mapped_id", "auto")
    assert auto == [("Lemon Juice", 8, True), ("fresh lemon juice", 8, True), ("rye", 9, True)]
    decisions = spark.createDataFrame(
        [("lemon juice", "existing", 7), ("rye", "new", None), ("gin", "skip", None)], "name string, type string, ingredient_id long"
    )
    got = rows(MP.map_group(names, decisions, catalogue), "name", "type", "mapped_id")
    assert got == [("Lemon Juice", "existing", 7), ("fresh lemon juice", "existing", 7), ("gin", "skip", None), ("rye", "new", None)]


def test_batch_gate(spark):
    recipes = spark.createDataFrame(
        [(1, "s", "A", "p2", "stir"), (2, "s", "A", "p1", "stir"), (3, "s", "B", "p3", "Shot Glass"), (4, "s", "Shot", "p4", ""),
         (5, "s", "shot", "p5", ""), (6, "s", "D", "p6", ""), (7, "s", "E", "p7", ""), (8, "s", "F", "p8", "")],
        "recipe_id long, source string, recipe_name string, path string, instructions string",
    )
    three = ["gin", "rum", "salt, optional"]
    uses = spark.createDataFrame(
        [(r, n) for r in (1, 2, 3, 4, 5, 6) for n in three] + [(7, "gin")] + [(8, n) for n in ("gin", "unknown", "rum")],
        "recipe_id long, ingredient_name string",
    )
    mapping = spark.createDataFrame([("gin",), ("rum",)], "name string")
    log = spark.createDataFrame([("s", "D", "rejected"), ("s", "F", "needs_review")], "source string, recipe_name string, status string")
    got = dict(rows(MP.batch_gate(recipes, uses, mapping, log), "recipe_id", "outcome"))
    assert got == {1: "repeated", 2: "auto_ingested", 3: "shot", 4: "shot", 5: "auto_ingested", 6: "processed", 7: "short", 8: "needs_review"}


def test_category_cover(spark):
    uses = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (2, 7)], "recipe_id long, ingredient_id long")
    categories = spark.createDataFrame([(5, "base"), (6, "sour"), (7, "base")], "ingredient_id long, category string")
    assert rows(FO.check_category_cover(uses, categories), "kind", "id", "category", "n") == [
        ("missing", 2, None, 1), ("recipe", 2, "base", 2)
    ]
    assert FO.check_category_cover(uses, categories.limit(0)).where("kind <> 'ingredient'").count() == 0


def put(folder, name, content):
    path = folder / name
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    taxonomy = {"rum": {"white rum": ["light rum"], "dark rum": []}, "gin": {"old tom": ["tom gin"]}}
    got = readers.read_taxonomy(spark, put(tmp_path, "t.json", taxonomy)).orderBy("ord")
    assert [r["term"] for r in got.collect()] == ["white rum", "light rum", "dark rum", "old tom", "tom gin"]
    brands = readers.read_brand_dictionary(spark, put(tmp_path, "b.json", {"Crémant de Loire": "sparkling wine"}))
    assert rows(brands) == [("crémant de loire", "sparkling wine")]
    mapping = {"a": {"id": 1, "name": "A", "mapped_at": "2025-01-02T03:04:05.6", "auto_matched": True}, "b": {"id": 2, "name": "B"}}
    assert rows(readers.read_mapping(spark, put(tmp_path, "m.json", mapping)), "name", "mapped_id", "auto") == [("a", 1, True), ("b", 2, False)]
    flat = {"current_index": 4, "accepted": ["x"], "rejected": [], "needs_review": [{"recipe_name": "y", "unmapped_ingredients": ["q"]}]}
    want = [("one", "x", "accepted"), ("one", "y", "needs_review")]
    assert rows(readers.read_status_log(spark, put(tmp_path, "k.json", {"one": flat, "two": {"accepted": []}}))) == want
    assert rows(readers.read_any_status_log(spark, put(tmp_path, "f.json", flat), "one")) == want
    assert rows(readers.read_any_status_log(spark, put(tmp_path, "k.json", {"one": flat}), "zero")) == want
    assert rows(readers.read_recipe_classes(spark, put(tmp_path, "c.json", {"sour": ["A", "B"]}))) == [(0, "sour", "A"), (0, "sour", "B")]
    assert rows(readers.read_recipe_classes(spark, put(tmp_path, "broken.json", "{oops"))) == []
    assert rows(readers.read_recipe_classes(spark, str(tmp_path / "missing.json"))) == []
    progress = put(tmp_path, "p.json", {"processed": ["a"], "skipped": ["b"], "current_ingredient": "c"})
    assert rows(readers.read_progress(spark, progress)) == [("a", "processed"), ("b", "skipped")]
    names = put(tmp_path, "n.json", {"ingredients": [{"name": "rye", "parent_name": ""}]})
    assert rows(readers.read_new_names(spark, names)) == [("rye", "")]
    documents = {"recipes": [{"name": "R", "ingredients": [{"ingredient_name": "gin", "amount": 2.5, "unit_name": "oz"}, {"ingredient_name": "ice", "amount": "", "unit_name": ""}]}]}
    uses = readers.document_uses(readers.read_recipe_documents(spark, put(tmp_path, "d.json", documents)))
    assert rows(uses, "position", "line", "ingredient_name", "amount", "unit_name") == [(0, 0, "gin", 2.5, "oz"), (0, 1, "ice", None, None)]


def test_latest_snapshot_and_skip_list(spark, tmp_path):
    old, new = put(tmp_path, "s1.csv", "name\nold\n"), put(tmp_path, "s2.csv", "name\nnew\nnewer\n")
    os.utime(old, (time.time() - 1000,) * 2)
    assert rows(readers.read_latest_snapshot(spark, str(tmp_path / "s*.csv"), "name string")) == [("new",), ("newer",)]
    folder = tmp_path / "html"
    folder.mkdir()
    for name in ("a.html", "b.html", "download_state.html"):
        put(folder, name, "<p>x</p>")
    pages = readers.read_page_corpus(spark, str(folder), "site")
    skip = put(tmp_path, "skip.txt", "# comment\n\nraw/html/b.html\n")
    assert [p.rsplit("/", 1)[1] for _, p in rows(readers.skip_listed_pages(pages, skip), "source", "path")] == ["a.html"]


def test_writers(spark, tmp_path):
    edges = spark.createDataFrame([(1, 2, [5], [6])], "id1 long, id2 long, only1 array<long>, only2 array<long>")
    writers.write_edge_tables(spark.createDataFrame([(1,), (2,)], "id long"), edges, str(tmp_path / "g"))
    assert rows(spark.read.csv(str(tmp_path / "g/edges"), header=True)) == [("1", "2", "5", "6")]
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.7)], "id1 long, id2 long, d double")
    wide = {r["id1"]: (r["1"], r["2"]) for r in writers.wide_distances(pairs, [1, 2]).collect()}
    assert wide == {1: (None, 0.5), 2: (0.5, None)}
    writers.write_new_names(spark.createDataFrame([("a",), ("a",)], "name string"), str(tmp_path / "n"))
    assert rows(spark.read.json(str(tmp_path / "n")), "name", "parent_name") == [("a", "")]


BOX = """<html><body><div class="entry-content"> A <b>fine</b> drink. </div><div class="recipe-box wide"><h1> Gin &amp; It </h1>
<ul class="ingredients-list"><li>2 ounces  ounces of <a>gin</a><li style="display:none">hidden</li><li>1/2 ounce ounce vermouth (sweet)</li><li> </li></ul>
<ol itemprop="recipeInstructions"><li>Stir.</li><li>Strain.</li></ol><p class="garn-glass">Cherry</p><h5>Editor's Note</h5><div></div><p>Old one.</p></div></body></html>"""
TABLE = """<html><head><link rel="canonical" href="https://e.org/r/1"></head><body><h1>Promo</h1><h1>Ale Sour</h1>
<table class="legacy-ingredients-table"><tr><th>Amount</th><th>Item</th></tr><tr><td>21⁄2oz</td><td>Ale <i>(or beer)</i></td></tr>
<tr><td>3 dash</td><td>Bitters<span>optional</span></td></tr><tr><td>x</td></tr></table><h1>Later</h1>
<h2>Review:</h2><p>Good.</p><h2>History:</h2><p>Old.</p></body></html>"""


def test_page_layouts(spark):
    pages = spark.createDataFrame(
        [("Box", "a.html", BOX), ("box", "none.html", "<p>nothing</p>"), ("tab", "b.html", TABLE), ("tab", "c.html", "<h1>X</h1>"), ("tab", "d.html", None)],
        "source string, path string, html string",
    )
    layout_of = {"BOX": "recipe_box", "tab": "ingredient_table"}
    got = {r["path"]: r for r in P.extract_recipes(pages, layout_of).collect()}
    assert sorted(got) == ["a.html", "b.html"]
    box, tab = got["a.html"], got["b.html"]
    assert box["name"] == "Gin & It" and box["description"] == "Afinedrink." and box["garnish"] == "Cherry"
    assert box["instructions"] == "Stir. Strain." and box["editors_note"] == "Old one."
    assert [tuple(i) for i in box["ingredients"]] == [("gin", 2.0, "ounce"), ("vermouth", 0.5, "ounce")]
    assert tab["name"] == "Ale Sour" and tab["source_url"] == "https://e.org/r/1" and tab["description"] == "Good. Old."
    assert tab["instructions"].startswith("Shake all") and box["source_url"] is None
    assert [tuple(i) for i in tab["ingredients"]] == [("ale(or beer)", 2.5, "ounce"), ("bittersoptional", 3.0, "dash")]
    with pytest.raises(Exception, match="unknown source"):
        P.extract_recipes(pages.limit(1).withColumn("source", F.lit("other")), layout_of).collect()
    tables = P.pages_to_tables(pages, layout_of)
    assert rows(tables["recipe"], "id", "name") == [(1, "Gin & It"), (2, "Ale Sour")] and tables["recipe_ingredient"].count() == 4


def test_clean_pages(spark):
    page = """<body><nav>menu</nav><article><header>h</header><p>Keep</p><div class="x share">no</div><p>Share</p><p>Tweet this <b>now</b></p>
<li itemprop="recipeIngredient" style="display:none">dup</li><img src="a"><p style="color:red">Red</p></article><footer>f</footer></body>"""
    pages = spark.createDataFrame([("s", "a", page), ("s", "b", TABLE)], "source string, path string, html string")
    box = {r["path"]: r["cleaned"] for r in P.clean_pages(pages).collect()}["a"]
    for gone in ("menu", "header", "no", "Share", "Tweet this", "dup", "img", "footer"):
        assert gone not in box.replace("now", "")
    assert "Keep" in box and "now" in box and 'style="color:red"' in box
    table = {r["path"]: r["cleaned"] for r in P.clean_pages(pages, "ingredient_table").collect()}
    assert table["a"] == page and table["b"].startswith("<h1>Ale Sour</h1><table") and "Later" not in table["b"] and "Old." in table["b"]


def test_fetch_logs(spark):
    log = spark.createDataFrame([("a", i, i % 60 == 0) for i in range(1, 200)] + [("b", 5, True), ("b", 6, False)], "source string, id long, found boolean")
    assert rows(P.find_miss_runs(log, 50)) == [("a", 1, 59, 59), ("a", 121, 179, 59), ("a", 61, 119, 59)]
    assert rows(P.fold_fetch_log(log)) == [("a", 199, 180, 3, 196), ("b", 6, 5, 1, 1)]
    candidates = spark.createDataFrame([(1,), (1,), (250,), (3,)], "id long")
    assert rows(P.plan_fetch(candidates, spark.createDataFrame([(3,)], "id long"))) == [(1, 0), (250, 2)]


def test_edges_are_made_once_for_both_tables(spark, monkeypatch):
    bags = spark.createDataFrame([(1, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 3, 1.0)], "recipe_id long, ingredient_id long, w double")
    plans, write = [], inputs.writers.write_edge_tables
    monkeypatch.setattr(inputs, "bags_of", lambda *a: (bags, None))
    monkeypatch.setattr(inputs.writers, "write_edge_tables", lambda nodes, edges, path: (
        plans.extend(t._jdf.queryExecution().optimizedPlan().toString() for t in (nodes, edges)), write(nodes, edges, path)
    ))
    got = sorted(tuple(r) for r in inputs.edge_tables(spark, "").fillna(0, ["id2"]).fillna("", ["only1"]).collect())
    assert got == [("edge", 1, 2, "2"), ("node", 1, 0, ""), ("node", 2, 0, "")]
    assert len(plans) == 2 and not any("Join" in p for p in plans)
