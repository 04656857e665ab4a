"""One query per corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottom_k, collocations, deleted_interpolation, dominance_packing, exact_dedup, license_scan, packing, piece_sampling, prefix_trie, quality_rff, simhash, toxicity, warc_zip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).withColumn("notices", F.to_json("notices"))


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archived_pages(table(spark, sf_dir, "pages")).drop("url")


def op3_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_segmentations(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), packed=True)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.lm_scores(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rff.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.edited_report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"), digests=True)


def op11_dominance_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominance_packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_warc_zip": op2_warc_zip,
    "op3_piece_sampling": op3_piece_sampling,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_deleted_interpolation": op6_deleted_interpolation,
    "op7_quality": op7_quality,
    "op8_bottom_k": op8_bottom_k,
    "op9_simhash": op9_simhash,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_dominance_packing": op11_dominance_packing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_zip": """
        with p as (select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest, octet_length(encode(coalesce(html, ''))) as payload_bytes from pages),
        f as (select *, min(page_id) over (partition by html) as first_id from p)
        select page_id, payload_bytes, payload_digest, case when payload_bytes >= 100 and first_id <> page_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and first_id <> page_id then first_id end as refers_to
        from f""",
    "op10_exact_dedup": r"""
        with n as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
        select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
               doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
        from n""",
    "op12_prefix_trie": """
        with t as (
            select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as i
            from conversations where conv_id is not null),
        ids as (select distinct conv_id, list_concat([4294967295], flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))) as steps from t),
        k as (select conv_id, xor(list_reduce(steps, lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295) % 9 as h from ids),
        r as (
            select k.conv_id, t.i, t.role, t.text from k join t on t.conv_id = k.conv_id - k.conv_id % 5 and t.i < k.h
            union all select t.conv_id, t.i, t.role, t.text from t join k on k.conv_id = t.conv_id and t.i >= k.h),
        w as (select k.conv_id, coalesce(list({'r': role, 't': text} order by i) filter (i is not null), []) as turns from k left join r on r.conv_id = k.conv_id group by k.conv_id),
        p as (select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from w),
        m as (select conv_id, depth, list_slice(turns, 1, depth) as prefix, len(turns) = depth as ends from p),
        n as (
            select prefix, depth, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
            from m group by prefix, depth),
        c as (select list_slice(prefix, 1, depth - 1) as prefix, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by 1, 2),
        g as (select n.*, coalesce(c.n_children, 0) as n_children, (n_convs - 1) * coalesce(strlen(n.prefix[n.depth].t), 0) as gain from n left join c on c.prefix = n.prefix and c.depth = n.depth),
        u as (select prefix, depth, n_children, gain, unnest(range(0, depth + 1)) as above from g),
        s as (select list_slice(prefix, 1, above) as prefix, above as depth, sum(gain) as saved_tokens, count(*) filter (n_children = 0) as n_leaves from u group by 1, 2)
        select g.conv_id, g.depth, q.conv_id as parent_conv_id, g.n_convs, g.n_children, s.n_leaves, s.saved_tokens::bigint as saved_tokens, g.ends_sha256
        from g join s on s.prefix = g.prefix and s.depth = g.depth left join n q on q.depth = g.depth - 1 and q.prefix = list_slice(g.prefix, 1, g.depth - 1)""",
    "op13_collocations": r"""
        with p as (
            select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
            from documents),
        w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from p),
        d as (select lang, w, len(w) as size, count(*) as m from w where len(w) > 0 group by all),
        places as (select lang, w, size, m, unnest(range(1, size + 1)) as i from d),
        g as (select lang, m, unnest(range(1, least(5, size - i + 1) + 1)) as words, w, i from places),
        f as (select lang, w[i : i + words - 1] as g, words, sum(m)::bigint as a from g group by all),
        n as (select lang, sum(a)::bigint as n from f where words = 1 group by lang),
        c as (select * from f where a >= 100 and words > 1),
        longer as (select lang, g[: words - 1] as g, a from c where words > 2 union all select lang, g[2 :], a from c where words > 2),
        inside as (select lang, g, max(a) as a from longer group by all),
        kept as (select c.* from c left join inside i on i.lang = c.lang and i.g = c.g where i.a is null or i.a < c.a),
        cuts as (select *, unnest(range(1, words)) as k from kept),
        scored as (
            select cuts.lang, array_to_string(cuts.g, ' ') as phrase, cuts.a, l.a as l, r.a as r, n.n, k,
                   ((1000 * cuts.a::hugeint * n.n::hugeint) // (l.a::hugeint * r.a::hugeint))::bigint as score
            from cuts join f l on l.lang = cuts.lang and l.g = cuts.g[: k] join f r on r.lang = cuts.lang and r.g = cuts.g[k + 1 :] join n on n.lang = cuts.lang),
        worst as (select *, row_number() over (partition by lang, phrase order by score, k) as place from scored),
        ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from worst where place = 1)
        select lang, rank, phrase, a, l, r, n, score from ranked where rank <= 2000""",
}
