"""Queries of this package's operators over the given tables, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, exact_topk, html_text, huffman_ids, merkle, mixing, quality, sentencepiece_lattice, sharding, simhash, spelling, token_counts, toxicity
from .common import table


def op1_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_topk(spark, sf_dir):
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"))


def op4_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark, sf_dir):
    """Token ids of every document, and a digest of the text that they decode to."""
    back = sentencepiece_lattice.encode(table(spark, sf_dir, "documents"), decoded=True)
    return back.select("doc_id", "n_tokens", "ids", F.crc32("text").alias("decoded_crc32"), F.char_length("text").cast("long").alias("decoded_chars"))


def op11_token_files(spark, sf_dir):
    return huffman_ids.token_files(table(spark, sf_dir, "documents"))


def op12_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_spelling(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = [op1_html_text, op2_toxicity, op3_exact_topk, op4_nearest, op5_token_counts, op6_quality, op7_simhash, op8_mixing, op9_sharding, op10_sentencepiece, op11_token_files, op12_manifest, op13_spelling, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql():
    return {"op3_exact_topk": OP3, "op12_manifest": OP12, "op13_spelling": OP13}


#: The ten highest integer inner products of each query.
OP3 = """
with v as (
    select vec_id, [cast(floor(1024 * cast(x as double)) as bigint) for x in embedding] as w
    from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id as vec_id,
        cast(list_sum([q.w[i] * c.w[i] for i in range(1, len(q.w) + 1)]) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), ranked as (
    select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""


#: crc32 of an ASCII or UTF-8 text, with the table of the polynomial 0xEDB88320 made by recursion.
CRC = """crc_steps as (
    select i, i as c, 0 as k from range(256) t(i)
    union all select i, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_steps where k < 8
), crc_table as materialized (select list(c order by i) as of_byte from crc_steps where k = 8)"""


def crc(text: str) -> str:
    of_bytes = f"[cast('0x' || substr(hex(encode({text})), 2 * i + 1, 2) as bigint) for i in range(octet_length(encode({text})))]"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {of_bytes}), lambda c, b: xor(c >> 8, of_byte[xor(c, b) & 255 + 1])))".replace("xor(c, b) & 255 + 1", "1 + (xor(c, b) & 255)")


#: Leaves, levels of eight, and a walk from every leaf to the root, one level a step.
OP12 = f"""
with recursive {CRC},
own as (
    select doc_id, lang, text,
        [coalesce(octet_length(encode(v)) || ':' || v, '-') for v in [cast(doc_id as varchar), source, lang, cast(n_chars as varchar)]] as head
    from documents
), leaves as materialized (
    select doc_id, lang, sha256(array_to_string(head, '') || coalesce(octet_length(encode(text)) || ':' || text, '-')) as digest,
        case when {crc("cast(doc_id as varchar)")} % 3 = 0 then sha256(array_to_string(head, '') || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) end as tampered
    from own cross join crc_table
), numbered as materialized (
    select *, cast(dense_rank() over (order by lang nulls first) - 1 as bigint) as tree, row_number() over (partition by lang order by doc_id nulls first, digest) - 1 as pos, count(*) over (partition by lang) as n from leaves
), levels as (
    select tree, cast(0 as bigint) as level, pos, n, digest from numbered
    union all
    select tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)) from levels where n > 1 group by tree, level, pos // 8, n
), subroots as materialized (select tree, digest from levels where n = 1),
top as (
    select cast(-1 as bigint) as tree, cast(0 as bigint) as level, tree as pos, count(*) over () as n, digest from subroots
    union all
    select tree, level + 1, pos // 8, (n + 7) // 8, sha256(string_agg(digest, '' order by pos)) from top where n > 1 group by tree, level, pos // 8, n
), nodes as materialized (select * from levels union all select * from top),
runs as materialized (select tree, level, pos // 8 as up, list(digest order by pos) as every from nodes where n > 1 group by all),
walk as (
    select doc_id, digest as leaf, tree as of, tree, cast(0 as bigint) as level, pos, n, '' as proof, coalesce(tampered, digest) as folded from numbered
    union all
    select w.doc_id, w.leaf, w.of, w.tree, w.level + 1, w.pos // 8, (w.n + 7) // 8,
        w.proof || array_to_string(list_concat(r.every[:w.pos % 8], r.every[w.pos % 8 + 2:]), ''),
        sha256(array_to_string(r.every[:w.pos % 8], '') || w.folded || array_to_string(r.every[w.pos % 8 + 2:], ''))
    from (select doc_id, leaf, of, case when n = 1 then -1 else tree end as tree, case when n = 1 then 0 else level end as level, case when n = 1 then of else pos end as pos,
            case when n = 1 then (select count(*) from subroots) else n end as n, proof, folded from walk where n > 1 or tree >= 0) w
        join runs r on r.tree = w.tree and r.level = w.level and r.up = w.pos // 8
)
select w.doc_id, leaf, s.digest as subroot, t.digest as root, sha256(proof) as proof_sha256, folded as folded_root, folded = t.digest as verified
from walk w join subroots s on s.tree = w.of cross join (select digest from top where n = 1) t
where w.n = 1 and (w.tree = -1 or (select count(*) from subroots) = 1)
"""

#: Words with one letter taken out: equal ones of the same place are a replacement, one that is a word is an insertion.
OP13 = f"""
with recursive {CRC},
runs as (select coalesce(cast(doc_id as varchar), '') || ':' as head, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run from documents),
hashed as (select run, {crc("head || run")} as h, count(*) as n from runs cross join crc_table where length(run) >= 7 group by head, run, of_byte),
words as materialized (
    select case when h % 31 = 0 then run[:h % length(run)] || run[h % length(run) + 2:] else run end as word, cast(sum(n) as bigint) as n
    from hashed group by 1 having length(word) >= 7 and sum(n) >= 2
), keys as materialized (select word, n, unnest(range(length(word))) as i, unnest([word[:i] || word[i + 2:] for i in range(length(word))]) as key from words),
near as materialized (
    select a.word, a.n, b.word as other, b.n as other_n from keys a join keys b on a.key = b.key and a.i = b.i where a.word <> b.word
    union select a.word, a.n, b.word, b.n from keys a join words b on a.key = b.word
    union select b.word, b.n, a.word, a.n from keys a join words b on a.key = b.word
),
best as (select word, count(*) as n_near, min(struct_pack(less := -other_n, other := other)) as best from near group by word),
forms as materialized (
    select w.word, w.n, coalesce(n_near, 0) as n_near, case when -best.less >= 10 * w.n then best.other end as form, case when -best.less >= 10 * w.n then -best.less end as form_n
    from words w left join best b on w.word = b.word
), chain as (
    select word, word as root, form from forms
    union all select c.word, f.word, f.form from chain c join forms f on c.form = f.word
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from forms f join chain c on c.word = f.word where c.form is null
"""
