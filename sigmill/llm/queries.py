"""The operators as queries over whole tables, with their contracts' columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, lines, media, mixing, packing, pii, repeats, simhash, toxicity
from .common import table


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def texts(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *more)


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(media.to_media(texts(spark, sf_dir)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(texts(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.groups(exact_dedup.identities(texts(spark, sf_dir)))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(texts(spark, sf_dir), vocabulary(), ids=False)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = texts(spark, sf_dir)
    ends = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n = F.when(F.col("text").isNull(), 0).otherwise(ends + 1).cast("long")
    found = lines.with_matches(docs.withColumn("n_lines", n), lines.later_matches(docs))  # counted first: no text goes through the join
    classes = "array_join(transform(classes, x -> concat(coalesce(cast(x.doc_id as string), ''), ':', x.line)), ',')"
    return found.select(
        "doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join("removed", ","), F.lit("")).alias("removed"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce(F.expr(classes), F.lit("")).alias("classes"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat.digests(chat.windows(turns.union(more)))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_counts(texts(spark, sf_dir, "source"))
    return found.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(texts(spark, sf_dir))
    said = lambda kinds: "array_join(transform(concat(" + ", ".join(kinds) + "), x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(F.expr(said(pii.BASE)).cast("binary"), 256).alias("base_sha256"), F.expr(said(pii.KINDS)).alias("spans"), F.expr(" + ".join(f"size({k})" for k in pii.KINDS)).cast("long").alias("n_spans"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(texts(spark, sf_dir))
    removed = F.expr("aggregate(spans, 0L, (s, x) -> s + x.end - x.start)")
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(texts(spark, sf_dir), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    return {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}


ORACLE: dict[str, str] = {
    "op3_exact_dedup": r"""
with n as (select doc_id, coalesce(text, '') as t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm from documents),
g as (select norm, count(*) as group_size, arg_min(doc_id, (-length(t), doc_id)) as keep_id from n group by norm)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.norm) as text_sha256 from n join g using (norm)""",
    "op5_line_dedup": r"""
with l as materialized (select doc_id, i - 1 as line, ls[i] as t from (select doc_id, string_split(text, chr(10)) as ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents where text is not null)),
w as materialized (select doc_id, line, doc_id::hugeint * 1000000000 + line as place, list_sort(list_distinct(list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) as w from l),
s as materialized (select w, len(w) as n, min(place) as first, row_number() over (order by min(place)) as sid from w where len(w) > 0 group by w),
df as (select t, row_number() over (order by count(*), t) as r from (select unnest(w) as t from s) group by t),
e as (select sid, n, r, row_number() over (partition by sid order by r) - 1 as i from (select sid, n, unnest(w) as t from s) join df using (t)),
p as materialized (select * from e where i < n - (4 * n + 4) // 5 + 1),
c as (select distinct a.sid as a, b.sid as b from p a join p b on a.r = b.r and a.sid < b.sid and 5 * a.n >= 4 * b.n and 5 * b.n >= 4 * a.n),
m as materialized (select c.a, c.b from c join s x on x.sid = c.a join s y on y.sid = c.b where 9 * len(list_intersect(x.w, y.w)) >= 4 * (x.n + y.n)),
k as (select a, count(*) as n, min(first) as other from (select a, b from m union all select b, a from m) join s on s.sid = b group by a),
f as (select w.doc_id, w.line, w.place > least(s.first, coalesce(k.other, s.first)) as gone, coalesce(k.n, 0) as n, s.first from w join s using (w) left join k on k.a = s.sid),
g as (select doc_id, count(*) filter (gone) as n_removed, string_agg(line::varchar, ',' order by line) filter (gone) as removed, sum(n) as n_links, string_agg((first // 1000000000)::varchar || ':' || (first % 1000000000)::varchar, ',' order by line) as classes from f group by doc_id)
select doc_id, case when text is null then 0 else len(string_split(text, chr(10))) end::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(removed, '') as removed, coalesce(n_links, 0)::bigint as n_links, coalesce(classes, '') as classes from documents left join g using (doc_id)""",
    "op6_chat": rf"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, replace(replace(replace(text, '\', '\\'), '<', '<\'), '[', '[\') as body from t),
n as (select *, strlen(body) + strlen(role) + 8 as n, length(body) + length(role) + 8 as chars, row_number() over (partition by conv_id order by turn nulls last, role, text) - 1 as pos from e),
h as (select conv_id, n as hn, chars as hchars from n where pos = 0 and role = 'system'),
p as (select n.*, sum(n) over (partition by conv_id order by pos) - n as start, coalesce(hn, 0) as hn, coalesce(hchars, 0) as hchars, hn is not null as headed, greatest(1, floor(({chat.BUDGET} - {chat.HISTORY} - coalesce(hn, 0)) / 2)) as span from n left join h using (conv_id)),
q as (select *, (n > span)::int as long, sum((n > span)::int) over (partition by conv_id order by pos) - (n > span)::int as longs from p),
w as (select conv_id, (2 * longs + long) * 2147483648 + floor(start / span) as win, min(start) as s, any_value(hchars) as hchars from q group by all having min(pos) > 0),
c as (select conv_id, sum(x) as more from (select conv_id, hchars as x from w union all select w.conv_id, q.chars from w join q on q.conv_id = w.conv_id and q.start < w.s and q.start >= w.s - {chat.HISTORY} and not (q.pos = 0 and q.headed)) group by conv_id)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) as turns_sha256, coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) as loss_sha256, (sum(chars) + coalesce(any_value(more), 0))::bigint as formatted_chars from q left join c using (conv_id) group by conv_id""",
    "op9_suffix_array": f"""
with d as materialized (select doc_id, encode(coalesce(text, '')) as b, octet_length(encode(coalesce(text, ''))) as n from documents),
p as (select doc_id, p, b[p + 1:p + {repeats.LENGTH}] as s from (select doc_id, b, unnest(range(0, n - {repeats.LENGTH} + 1)) as p from d where n >= {repeats.LENGTH})),
r as (select doc_id, p from p where s in (select s from p group by s having count(*) > 1)),
i as (select *, sum(fresh) over (partition by doc_id order by p) as run from (select *, case when p > lag(p) over (partition by doc_id order by p) + {repeats.LENGTH} then 1 else 0 end as fresh from r)),
g as materialized (select doc_id, run, min(p) as a, max(p) + {repeats.LENGTH} as z from i group by doc_id, run),
k as (select doc_id, string_agg(hex(b[before + 1:a]), '' order by a) || hex(any_value(b)[max(z) + 1:any_value(n)]) as kept, sum(z - a) as removed, count(*) as spans from (select g.*, b, n, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from g join d using (doc_id)) group by doc_id)
select doc_id, n::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans, case when k.doc_id is null then sha256(b) else sha256(unhex(kept)) end as kept_sha256 from d left join k using (doc_id)""",
    "op7_mixing": rf"""
with z as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size, ('0x' || substr(md5(doc_id::varchar || ':mix'), 1, 13))::bigint / 4503599627370496::double as draw from documents),
s as (select source, sum(size)::double as source_size, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as weight from z group by source),
o as (select *, 2 * source_size as cap, row_number() over (order by 2 * source_size / weight, source nulls last) as nth from s),
k as (select *, (1.5::double * (select sum(source_size) from s) - (sum(cap) over w - cap)) / ((select sum(weight) from s) - (sum(weight) over w - weight)) as level from o window w as (order by nth)),
t as (select source, source_size, coalesce(least(weight * (select min_by(level, nth) from k where weight * level < cap), cap), cap) as target from k),
r as (select *, coalesce(target / nullif(source_size, 0), 0) as rate from t),
c as (select source, floor(draw * {mixing.CELLS})::int as cell, sum(size)::double as size from z group by all),
b as (select *, sum(size) over (partition by source order by cell) - size as below from c),
u as (select r.source, max((cell + least((((rate - floor(rate)) * source_size) - below) / size, 1)) / {mixing.CELLS}::double) as upto from b join r on b.source is not distinct from r.source where size > 0 and below < (rate - floor(rate)) * source_size group by r.source)
select doc_id, size, source_size::bigint as source_size, target, (size * (floor(rate)::bigint + (draw < coalesce(upto, 0))::int))::bigint as taken from z join r on z.source is not distinct from r.source left join u on u.source is not distinct from r.source""",
}
