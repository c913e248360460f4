"""Merkle manifests against a plain tree over Python lists."""

import hashlib

from pyspark.sql import functions as F

from blendspark.llm import manifest

COLUMNS = "doc_id long, text string, lang string, leaf string, path int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain(rows):
    """(doc_id, leaf, subroot, root, siblings) of each row, sorted."""
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def tree(nodes):
        """nodes: (hash, [leaf records]); hands each record its siblings."""
        while len(nodes) > 1:
            up = []
            for k in range(0, len(nodes), 8):
                run = nodes[k:k + 8]
                for j, (_, members) in enumerate(run):
                    for m in members:
                        m["siblings"] += [h for x, (h, _) in enumerate(run) if x != j]
                up.append((digest(*[h for h, _ in run]), [m for _, ms in run for m in ms]))
            nodes = up
        return nodes[0]

    groups = {}
    for i, text, lang in rows:
        groups.setdefault(lang, []).append({"id": i, "leaf": digest(field(i), field(text), field(lang)), "siblings": []})
    tops = []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        group = sorted(groups[lang], key=lambda m: (m["id"] is not None, m["id"] or 0, m["leaf"]))
        top = tree([(m["leaf"], [m]) for m in group])
        for m in group:
            m["subroot"] = top[0]
        tops.append(top)
    if not tops:
        return []
    root, members = tree(tops)
    return sorted((str(m["id"]), m["leaf"], m["subroot"], root, digest(*m["siblings"])) for m in members)


def built(spark, rows, changed=None):
    docs = spark.createDataFrame([(i, t, g, "x", 1) for i, t, g in rows], COLUMNS).repartition(3)
    return manifest.manifest(docs, ["doc_id", "text", "lang"], "lang", "doc_id", changed and {"text": changed(docs)})


def seen(df):
    rows = df.withColumn("proof", manifest.proof_hash(F.col("path"))).collect()
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof) for r in rows)


def test_against_plain_tree(spark):
    rows = [(i, f"text {i}", "en" if i % 3 else ["de", "fr", None, "é", "Z"][i // 3 % 5]) for i in range(700)] + [(9000, "alone", "x")]
    assert seen(built(spark, rows)) == plain(rows)


def test_odd_rows(spark):
    same = [(5, "again", "en")] * 20
    rows = same + [(None, "no id", "en")] * 9 + [(1, None, None), (2, "", ""), (2, "é" * 200_000, "en"), (2, "-", "en"), (3, "-", None)]
    assert seen(built(spark, rows)) == plain(rows)
    assert seen(built(spark, [])) == []
    one = [(1, "a", None)]
    assert seen(built(spark, one)) == plain(one)
    many = [(i, "a", f"g{i}") for i in range(75)]  # more trees than one level holds
    assert seen(built(spark, many)) == plain(many)


def test_only_changed_leaves_fail(spark):
    rows = [(i, "Aa" if i % 2 else "aa", "en") for i in range(100)]
    got = built(spark, rows, lambda d: manifest.small_letters(d["text"]))
    folded = got.withColumn("ok", manifest.folded(F.col("changed_leaf"), F.col("path")) == F.col("root")).collect()
    assert {r.doc_id: r.ok for r in folded} == {i: i % 2 == 0 for i in range(100)}


def test_small_letters_leave_the_rest(spark):
    row = spark.createDataFrame([("AbÉZ", "AbZ[`")], "a string, b string").select(manifest.small_letters(F.col("a")), manifest.small_letters(F.col("b"))).first()
    assert tuple(row) == ("abÉz", "abz[`")
