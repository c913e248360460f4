"""Preference formatting against plain Python."""

from blendspark.llm import chat

HAND = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 2, "user", "and?"), (1, 3, "assistant", "no"),
    (2, None, "system", None), (2, 1, "user", "é😀"), (2, 1, None, "x"),
    (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, 0, "user", "long " * 20000), (None, 0, "user", "lost"),
]


def write(turns):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)


def spans(turns):
    at, out = 0, []
    for r, t in turns:
        begin = at + len(r) + 5
        at = begin + len(t) + 8
        if r == "assistant":
            out.append((begin, at))
    return out


def brute(rows):
    talks = {}
    for c, n, r, t in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        talks.setdefault(c, []).append((r or "", t or ""))
    at = {c: max([i for i, (r, _) in enumerate(t) if r == "assistant"], default=len(t) - 1) for c, t in talks.items()}
    ids, out = sorted(talks), {}
    for c, n in zip(ids, ids[1:] + ids[:1]):
        a, b = talks[c], talks[c][:at[c]] + talks[n][at[n]:]
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        out[c] = (k, write(a[:k]), write(a[k:]), write(b[k:]), spans(a[k:]), spans(b[k:]))
    return out


def test_swapped_replies(spark):
    schema = "conv_id long, turn long, role string, text string, pair_id string"
    turns = spark.createDataFrame([(*r, "x") for r in HAND], schema)
    got = {
        r.pair_id: (r.shared, r.prompt, r.chosen, r.rejected, [tuple(s) for s in r.chosen_mask], [tuple(s) for s in r.rejected_mask])
        for r in chat.preference_rows(chat.swapped_replies(turns)).collect()
    }
    assert got == brute(HAND)
    assert chat.preference_rows(chat.swapped_replies(turns.limit(0))).count() == 0


def test_given_pairs(spark):
    turn = "array<struct<role:string,text:string>>"
    pairs = spark.createDataFrame(
        [(1, [("user", "q"), ("assistant", "a")], [("user", "q"), ("assistant", "b")]), (2, None, [("user", "q")]), (3, [("user", "q")], [("user", "q")])],
        f"pair_id int, chosen {turn}, rejected {turn}",
    )
    got = {r.pair_id: r for r in chat.preference_rows(pairs).collect()}
    assert (got[1].prompt, got[1].chosen) == ("<|user|>\nq<|end|>\n", "<|assistant|>\na<|end|>\n")
    assert got[1].chosen[got[1].chosen_mask[0].start:got[1].chosen_mask[0].end] == "a<|end|>\n"
    assert (got[2].shared, got[2].chosen, got[2].rejected_mask) == (0, "", [])
    assert (got[3].shared, got[3].chosen, got[3].rejected) == (1, "", "")


def test_very_many_turns(spark):
    turns = [("user" if i % 2 else "assistant", "x" * (i % 3)) for i in range(100_000)]
    turn = "array<struct<role:string,text:string>>"
    row = chat.preference_rows(spark.createDataFrame([(1, turns, [])], f"pair_id int, chosen {turn}, rejected {turn}")).first()
    assert [tuple(s) for s in row.chosen_mask] == spans(turns) and row.rejected_mask == []


def test_partners_do_not_rest_on_exchange_reuse(spark):
    """More ids than the sample that finds the ranges, and no exchange read twice."""
    from pyspark.sql import functions as F

    n, reuse = 400_000, spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        wrong = chat.following(spark.range(n).select(F.col("id").alias("conv_id"))).where((F.col("conv_id") + 1) % n != F.col("next_id"))
        assert wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
