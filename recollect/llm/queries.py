"""The queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.shared import new_path, table

WORD_BPE = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.html_text import extract

    found = extract(table(spark, sf_dir, "pages"), columns=["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.token_files import file_digests, write_token_files

    path = new_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, public_tokenizers.path(WORD_BPE), end=2)
    return file_digests(spark, path)


def op4_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.resharding import reshard_files

    files = reshard_files(table(spark, sf_dir, "documents"), 24, F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    return files.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.near_dups import classes

    return classes(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.decontaminate import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), slop=2)
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "n_near",
    )


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.quality import quality

    judged = quality(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.substrings import remove_repeats

    cut = remove_repeats(table(spark, sf_dir, "documents"), columns=["doc_id"])
    return cut.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.bpe import bpe, digests

    return digests(bpe(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.warc import fixity

    # files and offsets hang on how the table is split among tasks; the tests check them against the bytes
    return fixity(table(spark, sf_dir, "pages"), new_path(spark, "warc")).select("page_id", "url", "length", "sha256", "status")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"), top=2000)


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.clusters import clusters

    return clusters(table(spark, sf_dir, "embeddings"))


def _clusters_sql(k: int, rounds: int) -> str:
    """Assignments (a0, ...) and centroids (c0, ...) of all rounds, one after another."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"a{i} as materialized (select n, min({{'s': s, 'c': c}}).c as c, min(s) as s from (select n, c, sum((e.x - c.x)::hugeint * (e.x - c.x)) as s from e join c{i} c using (d) group by n, c) group by n)")
        move = f"select a.c, e.d, sum(e.x) as t, count(*) as m from a{i} a join e using (n) group by 1, 2"
        steps.append(f"c{i + 1} as materialized (select c.c, c.d, coalesce((t - ((t % m) + m) % m) // m, c.x)::bigint as x from c{i} c left join ({move}) using (c, d))")
    steps.pop()
    return f"""
with v as materialized (select vec_id, row_number() over () as n, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as x from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
e as materialized (select n, unnest(x) as x, generate_subscripts(x, 1) as d from v),
seed as (select row_number() over (order by sha256('3:' || vec_id), x) - 1 as c, x from v),
c0 as materialized (select c, unnest(x) as x, generate_subscripts(x, 1) as d from seed where c < {k}),
{", ".join(steps)},
told as (select c, sha256(string_agg(x::varchar, ',' order by d)) as h from c{rounds} group by c)
select vec_id, c::int as cluster, s::bigint as distance, (sum(s) over (partition by c))::bigint as cluster_inertia, (sum(s) over ())::bigint as inertia, h as centroid_sha256
from v join a{rounds} using (n) join told using (c)"""


def op13_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recollect.llm.classifier import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_html_text": op2_html_text,
    "op3_token_files": op3_token_files,
    "op4_resharding": op4_resharding,
    "op5_near_dups": op5_near_dups,
    "op6_decontamination": op6_decontamination,
    "op7_quality": op7_quality,
    "op8_substrings": op8_substrings,
    "op9_bpe": op9_bpe,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_clusters": op12_clusters,
    "op13_classifier": op13_classifier,
}

SQL: dict[str, str] = {
    "op12_clusters": _clusters_sql(8, 10),
    "op10_warc": """
with r as (
  select page_id, url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::varchar, '')
    || '>' || chr(13) || chr(10) || 'WARC-Date: 2020-01-01T00:00:00Z' || coalesce(chr(13) || chr(10) || 'WARC-Target-URI: ' || url, '')
    || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10) || 'Content-Length: ' || coalesce(octet_length(encode(html)), 0)::varchar
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record
  from pages)
select page_id, url, octet_length(encode(record))::bigint as length, sha256(record) as sha256,
  case page_id % 61 when 0 then 'changed' when 1 then 'changed' when 2 then 'missing' else 'ok' end as status
from r""",
    "op11_collocations": r"""
with pieces as (select coalesce(lang, 'und') as lang, regexp_extract_all(x, '[^\x20\x09]+') as w from (select lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as x from documents)),
runs as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as p, w[i:i + k - 1] as t from pieces, unnest([1, 2, 3]) as s(k), unnest(range(1, len(w) - k + 2)) as u(i)),
f as (select lang, k, p, any_value(t) as t, count(*) as a from runs group by 1, 2, 3),
sizes as (select lang, sum(a) as n from f where k = 1 group by 1),
cand as (select * from f where k >= 2 and a >= 10),
inner_ as (select lang, array_to_string(t[1:2], ' ') as p, a from cand where k = 3 union all select lang, array_to_string(t[2:3], ' '), a from cand where k = 3),
longer as (select lang, p, max(a) as b from inner_ group by 1, 2),
kept as (select c.* from cand c left join longer using (lang, p) where k = 3 or b is null or 100 * b < 50 * a),
cuts as (select c.lang, c.p, c.a, j, x.a as l, y.a as r, (1000000::hugeint * c.a::hugeint * c.a::hugeint) // (x.a::hugeint * y.a::hugeint) as score
  from kept c, unnest([1, 2]) as s(j), f x, f y where j < c.k and x.lang = c.lang and x.p = array_to_string(c.t[1:j], ' ') and x.k = j and y.lang = c.lang and y.p = array_to_string(c.t[j + 1:c.k], ' ') and y.k = c.k - j),
best as (select lang, p, a, min({'s': score, 'j': j, 'l': l, 'r': r}) as b from cuts group by 1, 2, 3),
ranked as (select lang, row_number() over (partition by lang order by b.s desc, a desc, encode(p)) as rank, p, a, b from best)
select lang, rank::bigint as rank, p as phrase, a::bigint as a, b.l::bigint as l, b.r::bigint as r, n::bigint as n, b.s::bigint as score from ranked join sizes using (lang) where rank <= 2000""",
    # all pairs that share a shingle, by the plain and by the weighted similarity; no buckets
    "op5_near_dups": r"""
with recursive base as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
texts as (select k, w, m, row_number() over () as n from (select array_to_string(w, ' ') as k, any_value(w) as w, count(*) as m from base where len(w) > 0 group by 1)),
sh as (select n, m, s, count(*) as c from (select n, m, unnest(case when len(w) < 5 then [k] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from texts) group by 1, 2, 3),
least_ as (select greatest(10, 0.01::double * (select count(*) from documents), (select sum(m) from sh) / 1e6) as t, (select count(*) from documents)::double as total),
df as (select s, sum(m) as df from sh group by 1),
ws as (select n, s, c, c * case when df > t then 1 - 0.25::double * ln(df / t) / ln(total / t) else 1 end as x from sh join df using (s), least_),
tot as (select n, sum(c) as c, sum(x) as x from ws group by 1),
met as (select a.n as a, b.n as b, sum(least(a.c, b.c)) as c, sum(least(a.x, b.x)) as x from ws a join ws b on a.s = b.s and a.n < b.n group by 1, 2),
links as (select a, b from met join tot p on p.n = a join tot q on q.n = b where met.c >= 0.8 * (p.c + q.c - met.c) or met.x >= 0.8 * (p.x + q.x - met.x)),
member as (select doc_id, n from base join texts on array_to_string(base.w, ' ') = k where doc_id is not null),
both_ways as (select a, b from links union select b, a from links union select p.n, q.n from member p join member q using (doc_id)),
reach(a, b) as (select n, n from texts union select r.a, l.b from reach r join both_ways l on r.b = l.a),
class as (select p.doc_id, min(q.doc_id) as class_id from member p join reach on a = p.n join member q on q.n = b group by 1)
select distinct doc_id, coalesce(class_id, doc_id) as class_id from base left join class using (doc_id) where doc_id is not null""",
    "op6_decontamination": """
with d as (select doc_id, row_number() over () as r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
win as (select distinct item, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as s from b, unnest(range(1, len(w) - least(len(w), 10) + 2)) as t(i) where len(w) > 0),
sizes as (select distinct n from win),
place as (select r, i, n, array_to_string(w[i:i + n - 1], ' ') as s from d, sizes, unnest(range(1, len(w) - n + 2)) as t(i)),
hit as (select r, i, place.n, item from place join win on place.s = win.s and place.n = win.n),
win2 as (select n, string_split(s, ' ') as t from (select distinct n, s from win)),
head as (select r, p, w, w[p] as x from d, unnest(range(1, len(w) + 1)) as t(p)),
close as (select r, p, n, array_to_string(w[p:p + n - 1], ' ') <> array_to_string(t, ' ') as loose from head join win2 on x = t[1] where p + n - 1 <= len(w) and list_contains(w[greatest(p + n - 3, 1):p + n + 1], t[n]) and list_contains(w[greatest(p + n // 2 - 2, 1):p + n // 2 + 2], t[n // 2 + 1])
  and list_aggregate([list_contains(w[greatest(p + k - 2, 1):p + k + 2], t[k + 1]) for k in range(0, n)], 'bool_and')),
beside as (select r, count(distinct p + k) as n_near from close, unnest(range(0, n)) as t(k) where loose group by r),
covered as (select r, count(distinct i + k) as n_hit from hit, unnest(range(0, n)) as t(k) group by r),
named as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from hit) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0)::bigint as n_near
from d left join covered using (r) left join beside using (r) left join named using (r)""",
    "op8_substrings": """
with d as (select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select r, doc_id, i, array_to_string(w[i:i + 49], ' ') as s from d, unnest(range(1, len(w) - 48)) as t(i) where len(w) >= 50),
first as (select s, min(doc_id) as low from win group by s having min(doc_id) < max(doc_id)),
gone as (select distinct r, i + k as p from win join first using (s), unnest(range(0, 50)) as t(k) where doc_id > low),
per as (select r, list(p) as ps, count(*) as n_removed from gone group by r),
kept as (select d.r, string_agg(x, ' ' order by p) as kept from (select r, unnest(w) as x, generate_subscripts(w, 1) as p from d) d anti join gone using (r, p) group by d.r)
select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join per using (r) left join kept using (r)""",
}
