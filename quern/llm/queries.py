"""Queries of the training-data operators over the driver's tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import ann, balltree, centroids, decontaminate, lexical, licenses, lm, pieces, quality, secrets, simhash, tokencount, tokenfiles
from quern.llm.common import shared_path, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def PIECE_MODEL() -> str:  # noqa: N802
    return tokenizer_path("piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.tokenize(table(spark, sf_dir, "documents"), PIECE_MODEL())


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "ids")
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return tokenfiles.token_index(spark, path)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.document_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.search(table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    every = (op1_decontamination, op2_quality, op3_nearest, op4_licenses, op5_sentencepiece, op6_secrets, op7_token_files, op8_token_counts, op9_lm_scores, op10_simhash, op11_top_k, op12_ranked_search, op13_centroids)
    return {f.__name__: f for f in every} | {"pipeline": pipeline}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op1_sql() -> str:
    n = 13
    return f"""
with b as (select distinct coalesce(cast(item_id as varchar), '') item, {_words("text")} w from benchmark),
bg as (select distinct item, n, array_to_string(w[i + 1 : i + n], ' ') g from (select item, w, least({n}, len(w)) n, unnest(range(len(w) - least({n}, len(w)) + 1)) i from b where len(w) > 0)),
d as (select row_number() over () rid, doc_id, {_words("text")} w from documents),
sizes as (select distinct n from bg),
dg as (select rid, i, n, array_to_string(w[i + 1 : i + n], ' ') g from (select rid, w, n, unnest(range(len(w) - n + 1)) i from d, sizes where len(w) >= n)),
hit as (select rid, i, n, item from dg join bg using (n, g)),
words as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from (select distinct rid, i, n from hit)) group by rid),
items as (select rid, count(*) n_items, string_agg(item, ',' order by item) names from (select distinct rid, item from hit) group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from d left join words using (rid) left join items using (rid)"""


def _op4_sql() -> str:
    phrases = "(['gnu', 'general', 'public', 'license'], 'gpl'), (['apache', 'license'], 'apache'), (['cc', 'by'], 'cc-by'), (['mit', 'license'], 'mit')"
    templates = ", ".join(f"('{k}', list_distinct({t.split()!r}))" for k, t in licenses.TEMPLATES.items())
    return f"""
with d as (select row_number() over () rid, doc_id, {_words("text")} w from documents),
phrases(p, label) as (values {phrases}),
base as (select rid, i, label from (select rid, w, p, label, unnest(range(len(w) - len(p) + 1)) i from d, phrases where len(w) >= len(p)) where w[i + 1 : i + len(p)] = p),
base_of as (select rid, count(*) n_base, min(i) first_word, max(i) last_word, string_agg(distinct label, ',' order by label) base_labels from base group by rid),
templates(k, t) as (values {templates}),
blocks as (select rid, list_distinct(w[b + 1 : b + 256]) s from (select rid, w, unnest(range(0, greatest(1, len(w)), 128)) b from d)),
own as (select rid, k, max(len(list_intersect(t, s)) / cast(len(t) as double)) c from blocks, templates group by rid, k having c >= 0.8),
own_of as (select rid, max(c) c from own group by rid),
labels as (select rid, string_agg(label, ',' order by label) labels from (select rid, label from base union select rid, k from own) group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_base, 0) as bigint) n_base, first_word, last_word, coalesce(base_labels, '') base_labels, coalesce(labels, '') labels,
  cast(case when n_base > 0 then 1 else coalesce(c, 0) end as double) score
from d left join base_of using (rid) left join own_of using (rid) left join labels using (rid)"""


def _op6_sql() -> str:
    either = lambda word: "".join(c if c in "_?" else f"[{c.upper()}{c}]" for c in word)
    keyword = "|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))
    assign = rf"""({keyword})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    parts = []
    for k, (pattern, group, least) in enumerate(((assign, 2, 12), ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16), ("[A-Za-z0-9+/_=-]+", 0, 20))):
        parts.append(
            f"select rid, {k} k, v, list_sum(list_transform(p[1 : n], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : n - 1], lambda x: length(x))), 0) s, length(v) z from "
            f"(select rid, p, m, unnest(m) v, unnest(g) own, unnest(range(1, len(m) + 1)) n from (select rid, string_split_regex(t, '{pattern}') p, regexp_extract_all(t, '{pattern}') m, regexp_extract_all(t, '{pattern}', {group}) g from d)) where length(own) >= {least}"
        )
    uuid = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
    allow = " or ".join(f"regexp_matches(lower(v), '{p}')" for p in (uuid, "example|placeholder|changeme|dummy|sample", "0123456789abcdef|abcdefghijklmnop|1234567890123456"))
    entropy = f"list_max(list_transform(range(length(v) - 19), lambda i: list_aggregate(string_split(substr(v, i + 1, 20), ''), 'entropy')))"
    kinds = "'assign', 'access', 'hex', 'entropy'"
    return f"""
with d as (select row_number() over () rid, doc_id, coalesce(text, '') t from documents),
every as ({" union all ".join(parts)}),
kept as (select * from every where k < 3 or (regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') and not ({allow}) and {entropy} >= case when regexp_full_match(v, '[0-9A-Fa-f]+') then 2.85 else 3.65 end)),
named as (select rid, k, s, [{kinds}][k + 1] || ':' || cast(s as bigint) || ':' || cast(s + z as bigint) x from kept),
by_doc as (select rid, count(*) filter (k = 0) n0, count(*) filter (k = 1) n1, count(*) filter (k = 2) n2, string_agg(x, ',' order by s, k) filter (k < 3) base, string_agg(x, ',' order by s, k) spans from named group by rid)
select doc_id, cast(coalesce(n0, 0) as bigint) n_assign, cast(coalesce(n1, 0) as bigint) n_access, cast(coalesce(n2, 0) as bigint) n_hex, sha256(coalesce(base, '')) base_sha256, coalesce(spans, '') spans
from d left join by_doc using (rid)"""


_FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"


def _op11_sql() -> str:
    return f"""
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) v from embeddings where vec_id is not null and {_FINITE}),
p as (select q.vec_id query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) score from e q join e c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) k from p)
select query_id, cast(k as integer) as "rank", vec_id, score from r where k <= 5"""


def _op12_sql() -> str:
    return f"""
with d as (select row_number() over () rid, doc_id, {_words("text")} w from documents),
t as (select rid, doc_id, cast(len(w) as bigint) n, w from d where len(w) > 0),
corpus as (select count(*) nn, cast(sum(n) as bigint) ll from t),
held as (select rid, term, count(*) tf from (select rid, unnest(w) term from t) group by rid, term),
weight as (select term, cast(floor(1000 * ln((2 * nn + 2) / cast(2 * df + 1 as double))) as bigint) w from (select term, count(*) df from held group by term), corpus),
items as (select row_number() over () iid, item_id, {_words("text")} w from (select distinct item_id, text from benchmark)),
asked as (select iid, item_id, term, count(*) times from (select iid, item_id, unnest(w) term from items) group by iid, item_id, term),
long as (select rid, doc_id, 100 - 75 + ((75 * n * nn) // ll) m from t, corpus),
scores as (select iid, item_id, doc_id, cast(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) score from asked join held using (term) join weight using (term) join long using (rid) group by iid, item_id, rid, doc_id),
r as (select *, row_number() over (partition by iid order by score desc, doc_id) k from scores where score > 0)
select item_id, cast(k as integer) as "rank", doc_id, score from r where k <= 10"""


def _op13_sql() -> str:
    near = "select vec_id, rid, arg_min(c, struct_pack(a := d, b := c)) c, min(d) d from (select vec_id, rid, c, cast(list_sum(list_transform(range(1, 65), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) as bigint) d from e, c{k}) group by vec_id, rid"
    parts = [
        f"with e as materialized (select row_number() over () rid, vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) v from embeddings where len(embedding) = 64 and {_FINITE})",
        "c0 as materialized (select cast(row_number() over (order by h, v) - 1 as integer) c, v m from (select v, sha256('3:' || cast(vec_id as varchar)) h from e order by h nulls last, v limit 8))",
    ]
    for k in range(10):
        parts.append(f"a{k} as materialized ({near.format(k=k)})")
        parts.append(f"s{k} as materialized (select c, list(cast(floor(s / n) as bigint) order by i) m from (select c, i, sum(x) s, count(*) n from (select c, unnest(v) x, unnest(range(64)) i from a{k} join e using (rid)) group by c, i) group by c)")
        parts.append(f"c{k + 1} as materialized (select c, coalesce(s{k}.m, c{k}.m) m from c{k} left join s{k} using (c))")
    parts.append(f"final as materialized ({near.format(k=10)})")
    return ",\n".join(parts) + """
select vec_id, c as cluster, d as distance, cast(sum(d) over (partition by c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia, sha256(array_to_string(m, ',')) centroid_sha256 from final join c10 using (c)"""


def oracle_sql() -> dict[str, str]:
    """Of the operators that SQL can express on whole tables; the others are tested against brute force."""
    return {"op1_decontamination": _op1_sql(), "op4_licenses": _op4_sql(), "op6_secrets": _op6_sql(), "op11_top_k": _op11_sql(), "op12_ranked_search": _op12_sql(), "op13_centroids": _op13_sql()}
