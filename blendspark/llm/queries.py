"""One query per operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from blendspark.llm import chat, exact, leaks, manifest, mixing, negatives, overlap, packing, paragraphs, quality, secrets, sketch, toxicity
from blendspark.llm.frames import table, text_of
from blendspark.llm.labels import with_fold
from blendspark.llm.registry import ORACLES, QUERIES, query  # noqa: F401


@query("op10_exact_dedup", """
    with t as (select doc_id, coalesce(text, '') as text from documents)
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
           doc_id = max(doc_id) over w as kept, sha256(text) as text_sha256
    from t window w as (partition by text)
""")
def op10_exact_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = exact.duplicate_groups(docs, carry={"text_sha256": F.sha2(text_of(docs), 256)})
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op4_scaled_sketch")
def op4_scaled_sketch(spark, sf_dir):
    found = sketch.fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        sketch.as_text(F.col("sketch")).alias("fingerprint"),
        sketch.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited", "near_next",
    )


def _matches(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """The kept matches of a rule as rows (doc_id, start, rank, kind, n), in SQL: the
    gaps that a split by the pattern leaves, summed up with the matches before."""
    p = pattern.replace("'", "''")
    return f"""
    select doc_id, start, {rank} as rank, '{kind}' as kind, n from (
        select doc_id, part, n, sum(gap + n) over (partition by doc_id order by i) - n as start from (
            select doc_id, unnest(range(len(w))) as i, unnest(list_transform(w, lambda x: length(x))) as n,
                   unnest(list_transform(g, lambda x: length(x))) as part,
                   unnest(list_transform(s[:len(w)], lambda x: length(x))) as gap
            from (select doc_id, regexp_extract_all(text, '{p}') as w, regexp_extract_all(text, '{p}', {group}) as g,
                         string_split_regex(text, '{p}') as s from t)))
    where part >= {least}"""


def _secrets_sql() -> str:
    plain = {"access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}  # whole runs, filtered by their length afterwards
    rules = [_matches(i, k, plain.get(k, p), g, n) for i, (k, p, g, n) in enumerate(secrets.RULES)]
    joined = "string_agg(kind || ':' || start::bigint || ':' || (start + n)::bigint, ',' order by start, rank)"
    return f"""
    with t as (select doc_id, coalesce(text, '') as text from documents),
    m as ({" union all ".join(rules)}),
    s as (select doc_id, count(*) filter (rank = 0) as n_assign, count(*) filter (rank = 1) as n_access,
                 count(*) filter (rank = 2) as n_hex, {joined} filter (rank < 3) as base, {joined} as spans from m group by doc_id)
    select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
           sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
    from t left join s using (doc_id)"""


@query("op6_trigram_secrets", _secrets_sql())
def op6_trigram_secrets(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"].isin([r[0] for r in secrets.BASE_RULES]))
    return found.withColumn("base", base).select(
        "doc_id", *[secrets.count_of(F.col("base"), k).alias(f"n_{k}") for k, *_ in secrets.BASE_RULES],
        F.sha2(secrets.written(F.col("base")), 256).alias("base_sha256"),
        secrets.written(F.col("secrets")).alias("spans"),
    )


_SPANS = """
    coalesce((select string_agg((e - n)::bigint || ':' || e::bigint, ',' order by i) from (
        select i, role, length(text) + 8 as n, sum(length(role) + length(text) + 13) over (order by i) as e
        from (select unnest({0}).role as role, unnest({0}).text as text, unnest(range(len({0}))) as i)) where role = 'assistant'), '')"""
_WRITTEN = "coalesce(array_to_string(list_transform({0}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), ''), '')"


@query("op1_preference_format", f"""
    with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null),
    w as (select conv_id, list({{'role': role, 'text': text}} order by turn nulls first, role, text) as turns from t group by conv_id),
    a as (select conv_id, turns, coalesce(list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')), len(turns)) as at,
                 coalesce(lead(conv_id) over (order by conv_id), min(conv_id) over ()) as next_id from w),
    p as (select a.conv_id as pair_id, a.turns as c, a.turns[:a.at - 1] || b.turns[b.at:] as r from a join a b on a.next_id = b.conv_id),
    s as (select *, coalesce(list_min(list_filter(range(1, greatest(len(c), len(r)) + 1), lambda i: c[i] is distinct from r[i])) - 1, len(c)) as shared from p),
    d as (select pair_id, shared, c[:shared] as p, c[shared + 1:] as c, r[shared + 1:] as r from s)
    select pair_id, shared::int as shared, {_WRITTEN.format('p')} as prompt, {_WRITTEN.format('c')} as chosen, {_WRITTEN.format('r')} as rejected,
           {_SPANS.format('c')} as chosen_mask, {_SPANS.format('r')} as rejected_mask from d
""")
def op1_preference_format(spark, sf_dir):
    rows = chat.preference_rows(chat.swapped_replies(table(spark, sf_dir, "conversations")))
    spans = {m: F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["start"], s["end"])), ",") for m in ("chosen_mask", "rejected_mask")}
    return rows.withColumns(spans)


@query("op3_source_mix", r"""
    with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
    s as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source is null, encode(source)) - 1 as no from d group by source),
    w as (select *, no % 3 + 1 as weight, 3 * source_size / (no % 3 + 1) as stop from s),
    b as (select *, coalesce(sum(weight) over o, 0) as wb, coalesce(sum(source_size) over o, 0) as sb from w
          window o as (order by stop, no rows between unbounded preceding and 1 preceding)),
    l as (select *, (sum(source_size) over () - 3 * sb)::bigint / (sum(weight) over () - wb)::bigint as level from b),
    g as (select source, no, source_size, coalesce(least((select arg_min(level, (stop, no)) from l where level <= stop) * weight, (3 * source_size)::double), 0.0) as target from w),
    q as (select doc_id, max(quality) as q from labels where doc_id is not null group by doc_id),
    k as (select d.doc_id, size, no, source_size, target,
                 -ln((('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint::double + 0.5) / 4503599627370496.0)
                 / (case when q is null then 0.5 when q > 0 then 1.0 else 0.25 end) as key
          from d join g on d.source is not distinct from g.source left join q on d.doc_id = q.doc_id),
    p as (select *, coalesce(sum(size) over (partition by no order by key, doc_id rows between unbounded preceding and 1 preceding), 0) as before,
                 case when source_size > 0 then floor(target / source_size) else 1 end as epochs from k)
    select doc_id, size, source_size, target,
           cast(size * (epochs + case when size > 0 and before + size / 2 <= target - epochs * source_size then 1 else 0 end) as bigint) as taken
    from p
""")
def op3_source_mix(spark, sf_dir):
    found = mixing.plan(table(spark, sf_dir, "documents"), mixing.quality_weights(table(spark, sf_dir, "labels")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


@query("op2_hilbert_packing")
def op2_hilbert_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), added=True)


@query("op9_toxicity")
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return with_fold(scored, 0.5)


@query("op8_quality")
def op8_quality(spark, sf_dir):
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return with_fold(scored, 0.3)


@query("op7_ngram_jaccard")
def op7_ngram_jaccard(spark, sf_dir):
    return overlap.overlap_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op5_paragraph_minhash")
def op5_paragraph_minhash(spark, sf_dir):
    return paragraphs.repeated_spans(table(spark, sf_dir, "documents")).drop("row")


@query("op11_hard_negatives", """
    with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                      list_transform(embedding, lambda x: floor(256 * x::double)) as v
               from embeddings where vec_id is not null and label is not null and embedding is not null
               and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as (select a.vec_id as anchor, b.vec_id as id, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as score
          from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
    p as (select * from s where same qualify row_number() over (partition by anchor order by score desc, id) <= 5)
    select p.anchor as anchor_id, p.id as positive_id, row_number() over w as rank, s.id as negative_id,
           p.score as positive_score, s.score as negative_score
    from p join s on p.anchor = s.anchor and not s.same and 80 * p.score <= 100 * s.score and s.score <= p.score
    window w as (partition by p.anchor, p.id order by s.score desc, s.id) qualify row_number() over w <= 5
""")
def op11_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    label = vectors["label"].cast("long")
    label = F.when(vectors["vec_id"] % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.hard_negatives(negatives.usable(vectors, label), F.col("vec_id") % 100 == 0)


def _manifest_sql(levels: int = 7) -> str:
    """The levels of both trees one by one; a lone node passes as it is."""
    def leaf(text: str) -> str:
        parts = [f"coalesce(octet_length(encode({v}))::varchar || ':' || {v}, '-')" for v in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)]
        return f"sha256({' || '.join(parts)})"

    def climb(name: str, depth: int) -> str:
        steps = [
            f"{name}{k + 1} as (select g, i // 8 as i, (n + 7) // 8 as n, case when n = 1 then min(h) else sha256(string_agg(h, '' order by i)) end as h "
            f"from {name}{k} group by g, i // 8, n)" for k in range(depth)
        ]
        kids = [f"{name}k{k} as (select g, i // 8 as i, n, list(h order by i) as c from {name}{k} group by g, i // 8, n)" for k in range(depth)]
        return ", ".join(steps + kids)

    def fold(source: str, name: str, depth: int, group: str, place: str) -> tuple[str, str]:
        """Each leaf carries its hash (f), its siblings so far (s) and its place (i)."""
        out, before = [], source
        for k in range(depth):
            left, right = "array_to_string(c[:(p.{0} // {1}) % 8], '')".format(place, 8**k), "array_to_string(c[(p.{0} // {1}) % 8 + 2:], '')".format(place, 8**k)
            out.append(
                f"{source}{name}{k} as (select p.* exclude (f, s), case when k.n = 1 then f else sha256({left} || f || {right}) end as f, "
                f"case when k.n = 1 then s else s || {left} || {right} end as s from {before} p join {name}k{k} k on k.g = p.{group} and k.i = p.{place} // {8 ** (k + 1)})"
            )
            before = f"{source}{name}{k}"
        return ", ".join(out), before

    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    crc = "(select crc from crcs where id is not distinct from d.doc_id)"
    lower, last = fold("leaf", "t", levels, "g", "i")
    upper, top = fold(last, "r", levels, "zero", "g")
    return f"""
    with recursive poly as (select n::ubigint as n, n::ubigint as c, 0 as k from range(256) x(n)
        union all select n, case when c % 2 = 1 then xor(c // 2, 3988292384::ubigint) else c // 2 end, k + 1 from poly where k < 8),
    crctable as (select list(c order by n) as t from poly where k = 8),
    digits as (select doc_id as id, list_transform(range(1, length(doc_id::varchar) + 1), lambda j: ascii(substr(doc_id::varchar, j, 1))) as b from (select distinct doc_id from documents)),
    crcs as (select id, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(b, lambda x: x::ubigint)),
        lambda c, x: xor(c // 256, t[xor(c % 256, x)::bigint + 1])), 4294967295::ubigint) as crc from digits, crctable),
    d as (select *, {leaf('text')} as leaf, {leaf(low)} as low from documents),
    o as (select d.*, case when {crc} % 3 = 0 then low else leaf end as given,
                 dense_rank() over (order by lang is not null, encode(lang)) - 1 as g,
                 row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from d),
    t0 as (select g, i, n, leaf as h from o), {climb('t', levels)},
    r0 as (select 0 as g, g as i, count(*) over () as n, h from t{levels}), {climb('r', levels)},
    leaf as (select doc_id, leaf, g, i, 0 as zero, given as f, '' as s from o),
    {lower}, {upper}
    select doc_id, leaf, t{levels}.h as subroot, r{levels}.h as root, sha256(s) as proof_sha256, f as folded_root, f = r{levels}.h as verified
    from {top} x join t{levels} on t{levels}.g = x.g, r{levels}"""


@query("op12_merkle_manifest", _manifest_sql())
def op12_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 3 == 0, manifest.small_letters(docs["text"])).otherwise(docs["text"])
    proofs = manifest.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": text})
    rows = proofs.withColumns({"proof_sha256": manifest.proof_hash(F.col("path")), "folded_root": manifest.folded(F.col("changed_leaf"), F.col("path"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query("op13_winnowed_leaks", r"""
    with low as (select doc_id, row_number() over () as row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
    d as (select doc_id, row, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from low),
    b as (select item_id::varchar as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
    i as (select distinct item_id, m, array_to_string(w[j:j + m - 1], ' ') as x from
          (select *, unnest(range(1, len(w) - m + 2)) as j from (select *, least(10, len(w)) as m from b where len(w) > 0))),
    o as (select row, m, j, array_to_string(w[j:j + m - 1], ' ') as x from
          (select row, w, m, unnest(range(1, len(w) - m + 2)) as j from d, (select distinct m from i) where len(w) >= m)),
    f as (select row, m, j, x from o where x in (select x from i)),
    h as (select row, count(distinct k) as n_hit from (select row, unnest(range(j, j + m)) as k from f) group by row),
    n as (select row, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from
          (select distinct row, item_id from f join i using (x) where item_id is not null) group by row)
    select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
           sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join h using (row) left join n using (row)
""")
def op13_winnowed_leaks(spark, sf_dir):
    found = leaks.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
