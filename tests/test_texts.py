"""Line parsing, names, units and brands on known cases."""

import pytest
from pyspark.sql import functions as F

from blendspark.functions import text as T
from blendspark.functions import trees
from blendspark.functions import units as U
from blendspark.operators import lines as L
from blendspark.operators import matching as MT

# Per rule: amounts, spans, signs, qualifiers and notes, units, special amounts, odd input.
LINES = [
    ("7 cl pisco", 7.0, "cl", "pisco"),
    ("0.25 Tsp. maraschino", 0.25, "teaspoon", "maraschino"),
    ("4 3/8 oz tonic", 4.375, "ounce", "tonic"),
    ("5/4 oz mezcal", 1.25, "ounce", "mezcal"),
    ("6-9 drops saline", 7.5, "drop", "saline"),
    ("4 to 7 oz cider", 5.5, "ounce", "cider"),
    ("¾ oz Campari", 0.75, "ounce", "campari"),
    ("3¼ oz cold brew", 3.25, "ounce", "cold brew"),
    ("5 ¾ oz sake", 5.75, "ounce", "sake"),
    ("6 pears, sliced", 6.0, None, "pears, sliced"),
    ("Absinthe", None, None, "absinthe"),
    ("short 3 oz Aquavit", 3.0, "ounce", "aquavit"),
    ("heaping 2 tbsp. sugar", 2.0, "tablespoon", "sugar"),
    ("5 oz verjus (or cider vinegar)", 5.0, "ounce", "verjus"),
    ("(about 2 oz) short 1 OZ. Rum", 1.0, "ounce", "rum"),
    ("Tonic water, to top", None, "to top", "Tonic water"),
    ("cava (to top)", None, "to top", "cava"),
    ("2 oz soda to top", None, "to top", "2 oz soda"),
    ("Honey as needed", None, "as needed", "Honey"),
    ("", None, None, ""),
    (" \t ", None, None, ""),
    ("()", None, None, "()"),
    ("1/0 oz gin", None, None, "1/0 oz gin"),
    ("1/2 to 3/4 oz gin", 0.5, None, "to 3/4 oz gin"),
    ("1 2 limes", 1.0, None, "2 limes"),
    ("2 bar spoons syrup", 2.0, None, "bar spoons syrup"),
    ("\t1 oz   pear   brandy ", 1.0, "ounce", "pear brandy"),
]


def test_parse_lines(spark):
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(LINES)], "id int, text string")
    got = {r["id"]: (r["amount"], r["unit"], r["ingredient"]) for r in L.parse_lines(rows).collect()}
    assert [got[i] for i in range(len(LINES))] == [c[1:] for c in LINES]


def test_parentheses_can_be_kept(spark):
    row = L.parse_lines(spark.createDataFrame([("30 ml Gin (or Vodka)",)], "text string"), keep_parentheses=True).first()
    assert (row["amount"], row["unit"], row["ingredient"]) == (30.0, "ml", "gin (or vodka)")


@pytest.mark.parametrize("text, expected", [
    ("3 cups fresh orange juice", "orange juice"),
    ("6 tbsp premium cocoa nibs", "cocoa nibs"),
    ("5 drops Orange Flower water", "orange flower water"),
    ("Freshly cracked pepper", "cracked pepper"),
    ("\t wide \t  open   spaces ", "wide open spaces"),
    ("good quality bitters", "quality bitters"),
    ("Maker’s bourbon", "maker's bourbon"),
])
def test_normalize_text(spark, text, expected):
    assert spark.range(1).select(T.normalize_text(F.lit(text))).first()[0] == expected


@pytest.mark.parametrize("text, expected", [
    ("pisco (ideally Peruvian)", "pisco"),
    ("(one small glass) sherry", "sherry"),
    ("bitters,   orange   ", "bitters, orange"),
    ("port (ruby) (aged) wine", "port wine"),
])
def test_clean_name(spark, text, expected):
    assert spark.range(1).select(T.clean_name(F.lit(text))).first()[0] == expected


def test_match_key_joins_spellings(spark):
    names = ["Fresh Lemon Juice", "lemon juice, fresh", "lemon  juice (fresh)", "Lemon Juice"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r[0] for r in rows.select(T.match_key(F.col("name"))).collect()} == {"lemon juice"}


def test_units(spark):
    cases = [
        (1.0, "ounce", 29.5735), (1.0, "oz.", 29.5735), (1.0, "slice", 0.0), (None, "ml", None), (2.0, None, None),
        (0.0, "oz", 0.0), (3.0, "to top", 90.0), (None, "to top", None), (2.0, "handful", 0.0), (2.0, "TBSP.", 29.5736),
    ]
    rows = spark.createDataFrame([(i, a, u) for i, (a, u, _) in enumerate(cases)], "id int, a double, u string")
    got = {r["id"]: r["ml"] for r in rows.select("id", U.to_ml(F.col("a"), F.col("u")).alias("ml")).collect()}
    for i, (_, _, ml) in enumerate(cases):
        assert got[i] == (None if ml is None else pytest.approx(ml))
    topped = rows.select("id", U.to_ml(F.col("a"), F.col("u"), 90.0).alias("ml")).where("id = 7").first()["ml"]
    assert topped == 90.0


def test_brand_extraction(spark):
    cases = [
        ("pisco, preferably barsol", "barsol", "pisco"),
        ("tequila such as ocho", "ocho", "tequila"),
        ("plain tequila", None, "plain tequila"),
        ("suze", "suze", "gentian liqueur"),
        ("absinthe, to rinse", None, "absinthe, to rinse"),
        ("rum (like plantation)", "plantation", "rum"),
        ("amaro, averna", "averna", "amaro"),
        ("rye, preferably dr. wm. ten mile", "dr. wm. ten mile", "rye"),
        ("crème, such as crémant de loire", "crémant de loire", "crème"),
    ]
    brands = spark.createDataFrame([("Suze", "gentian liqueur")], "brand string, generic string")
    rows = spark.createDataFrame([(c[0],) for c in cases], "text string")
    got = {r["text"]: (r["brand"], r["cleaned"]) for r in L.extract_brand(rows, brands).collect()}
    assert got == {c[0]: c[1:] for c in cases}


TAXONOMY = [
    (0, "sherry", "fino sherry", "fino sherry"), (1, "brandy", "pear brandy", "pear brandy"),
    (2, "brandy", "plum brandy", "plum brandy"), (3, "rum", "white rum", "white rum"), (4, "rum", "white rum", "light rum"),
    (5, "liqueur", "dr. jaglas", "dr. jaglas"), (6, "odd", "-", "--"), (7, "odd", "late", "fino sherry"),
]


def test_match_taxonomy(spark):
    taxonomy = spark.createDataFrame(TAXONOMY, "ord int, category string, specific_type string, term string")
    texts = [
        "fino sherry", "brandy, preferably Dr. Fischer Reserve", "liqueur", "any good plum brandy", "hot water",
        "2 oz Light Rum", "Dr. Jaglas amaro", "rums", "dr jaglas", "a--b",
    ]
    rows = spark.createDataFrame([(t,) for t in texts * 3], "text string")
    got = {
        r["text"]: (r["brand"], r["specific_type"], r["category"], r["confidence"])
        for r in MT.match_taxonomy(rows, taxonomy).collect()
    }
    assert got == {
        "fino sherry": (None, "fino sherry", "sherry", 1.0),
        "brandy, preferably Dr. Fischer Reserve": ("dr. fischer reserve", None, "brandy", 1.0),
        "liqueur": (None, None, "liqueur", 1.0),
        "any good plum brandy": (None, "plum brandy", "brandy", 0.9),
        "2 oz Light Rum": (None, "white rum", "rum", 1.0),
        "Dr. Jaglas amaro": (None, "dr. jaglas", "liqueur", 0.9),
        "a--b": (None, "-", "odd", 0.9),
    }


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(measure, a, b):
    import difflib

    if a == b:
        return 1.0
    if measure == "ratio":
        return difflib.SequenceMatcher(None, a, b).ratio()
    return 1 - edits(a, b) / max(len(a), len(b))


@pytest.mark.parametrize("measure", ["levenshtein", "ratio"])
def test_suggestions_against_brute_force(spark, measure):
    import random

    rng = random.Random(3)
    words = ["gin", "dry", "rum", "old", "rye", "lemon", "lime", "sugar", "syrup", "ginger", "beer", "bitter", "a", "é漢"]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(80)})
    entries = sorted({" ".join(rng.sample(words, rng.randint(1, 3))) for _ in range(80)} | {"ab", "x", "ba", "xyz"})
    catalogue = spark.createDataFrame([(i, n, f"/{i}/") for i, n in enumerate(entries)], "id long, name string, path string")
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r["name"], r["id"]): r["similarity"] for r in MT.suggest_matches(rows, catalogue, top=1000, measure=measure).collect()}
    want = {}
    for n in names:
        for i, e in enumerate(entries):
            s = similar(measure, n, e)
            if s >= 0.6 - 1e-9 or n in e or e in n:
                want[n, i] = s
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_segments_find_all_and_few(spark):
    """On random strings no near pair is lost; on names of three words few pairs are met."""
    import random

    rng = random.Random(8)
    short = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(150)]
    long = [" ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(3, 8))) for _ in range(3)) for _ in range(300)]
    one = lambda rows, c: spark.createDataFrame([(x,) for x in sorted(set(rows))], f"{c} string")
    for rows in (short, long):
        left, right = sorted(set(rows[::2])), sorted(set(rows[1::2]))
        met = {tuple(r) for r in MT.edit_keys(one(left, "name_key"), one(right, "entry_key"), 0.6).collect()}
        near = {(a, b) for a in left for b in right if a and b and a != b and similar("levenshtein", a, b) >= 0.6 - 1e-9}
        assert near <= met
    assert len(met) < 0.05 * len(left) * len(right)
    held = {tuple(r) for r in MT.held_keys(one(short[::2], "i"), "i", one(short[1::2], "o"), "o").collect()}
    assert held == {(a, b) for a in short[::2] for b in short[1::2] if a and a in b}


def test_spans_are_what_whole_word_patterns_find(spark):
    import re

    terms = ["st. germain", "germain", "-", "--", "st", ".", "st.", "a", "b c", "é", "(dry)", "dry)", "(", "n"]
    texts = ["st. germain", "the st. germain!", "stgermain", "a--b", "a-b", "--", "a", "b c a", "café", "é n", "gin (dry)", "x(dry)y", "", "b  c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", MT.spans(F.col("t"), 9).alias("s")).collect()
    for r in rows:
        assert {x for x in terms if x in r.s} == {x for x in terms if re.search(rf"\b{re.escape(x)}\b", r.t)}, r.t


def test_paths(spark):
    row = spark.range(1).select(
        trees.path_nodes(F.lit("/1/22/389/")).alias("nodes"), trees.path_nodes(F.lit(None).cast("string")).alias("none"),
        trees.parent_path(F.lit("/1/22/")).alias("parent"), trees.parent_path(F.lit("/1/")).alias("top"),
        trees.common_depth(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(2), F.lit(3))).alias("all_of_first"),
        trees.common_depth(F.array(F.lit(1), F.lit(2)), F.array(F.lit(1), F.lit(5))).alias("one"),
        trees.common_depth(F.array(F.lit(9)), F.array(F.lit(1))).alias("nothing"),
    ).first()
    assert row["nodes"] == [1, 22, 389] and row["none"] == [] and row["parent"] == "/1/" and row["top"] is None
    assert (row["all_of_first"], row["one"], row["nothing"]) == (2, 1, 0)


def test_addresses(spark):
    row = spark.range(1).select(
        T.source_url(F.lit("Rhum & Co’s  Sour - No. 2"), "https://e.org/", "/", True).alias("amp"),
        T.source_url(F.lit("Rhum & Co’s Sour"), "https://e.org/").alias("plain"),
        T.db_path(F.lit("/a/b/c/d.html")).alias("db"), T.db_path(F.lit("d.html")).alias("bare"),
        T.url_to_filename(F.lit("https://e.org/recipes/a%20b/?x=1")).alias("file"),
    ).first()
    assert row["amp"] == "https://e.org/rhum-and-cos-sour-no-2/" and row["plain"] == "https://e.org/rhum-cos-sour"
    assert row["db"] == "raw_recipes/c/d.html" and row["bare"] == "d.html" and row["file"] == "a_20b.html"


def test_markup_of_any_depth():
    from blendspark.functions.markup import parse

    html = "<div>" * 3000 + '<p class="a">x &amp; y<br>z</p>' + "</div>" * 3000
    root = parse(html)
    assert root.html() == html
    root.find("p").remove()
    assert root.html() == "<div>" * 3000 + "</div>" * 3000
