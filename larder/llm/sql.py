"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

HAMMING = """
with codes as (
    select distinct vec_id, list_aggregate(list_transform(embedding, lambda x: case when x > 0 then '1' else '0' end), 'string_agg', '')::bit as code
    from embeddings where embedding is not null
)
select q.vec_id as query_id,
    cast(row_number() over (partition by q.vec_id, q.code order by bit_count(xor(q.code, c.code)), c.vec_id) as integer) as rank,
    c.vec_id as neighbor_id, cast(bit_count(xor(q.code, c.code)) as bigint) as distance
from codes q join codes c on not (q.vec_id = c.vec_id and q.code = c.code)
where q.vec_id % 20 = 0
qualify rank <= 10
"""

_WORDS = """list_filter(string_split_regex(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')"""

CONTAMINATION = f"""
with docs as materialized (
    select doc_id, row_number() over () as rid, coalesce({_WORDS.format("text")}, []) as words from documents
),
items as materialized (
    select cast(item_id as varchar) as item, {_WORDS.format("text")} as words from benchmark
),
item_windows as materialized (
    select distinct item, n, list_aggregate(list_slice(words, a, a + n - 1), 'string_agg', ' ') as body
    from (select item, words, least(len(words), 10) as n, unnest(range(1, len(words) - least(len(words), 10) + 2)) as a from items where len(words) > 0)
),
hits as materialized (
    select d.rid, d.a, d.n, i.item
    from (select rid, n, a, list_aggregate(list_slice(words, a, a + n - 1), 'string_agg', ' ') as body
          from (select rid, words, n, unnest(range(1, len(words) - n + 2)) as a
                from docs, (select distinct n from item_windows) where len(words) >= n)) d
    join item_windows i on i.n = d.n and i.body = d.body
),
counted as (select rid, count(distinct place) as n_hit from (select rid, unnest(range(a, a + n)) as place from hits) group by rid),
named as (select rid, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rid, item from hits) group by rid)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
    sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs left join counted using (rid) left join named using (rid)
"""

NEGATIVES = """
with vectors as materialized (
    select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
        list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
scored as materialized (
    select a.vec_id as anchor_id, b.vec_id as id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
    from vectors a join vectors b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
),
liked as (
    select anchor_id, id as positive_id, score as positive_score from scored where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, id) as integer) as rank,
    id as negative_id, positive_score, score as negative_score
from liked join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5
"""

RESAMPLE = f"""
with crc_step as materialized (
    select list(list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as step
    from range(256) r(i)
),
docs as materialized (select row_number() over () as rid, doc_id, coalesce({_WORDS.format("text")}, []) as words from documents),
doc_words as materialized (select rid, word, count(*) as n from (select rid, unnest(words) as word from docs) group by all),
target_words as materialized (
    select word, count(*) as n from (select unnest({_WORDS.format("text")}) as word from benchmark) group by all
),
buckets as materialized (
    select word, xor(list_reduce(
        list_prepend(4294967295, list_transform(range(1, strlen(word) + 1), lambda i: cast('0x' || substr(hex(word), 2 * i - 1, 2) as bigint))),
        lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 as bucket
    from (select word from doc_words union select word from target_words), crc_step
),
gains as materialized (
    select bucket, cast(floor(1000 * ln((coalesce(t, 0) + 1)::double * (sum_s + 10000) / ((coalesce(s, 0) + 1)::double * (sum_t + 10000)))) as bigint) as gain
    from (select bucket, sum(n)::bigint as s from doc_words join buckets using (word) group by bucket) a
    full join (select bucket, sum(n)::bigint as t from target_words join buckets using (word) group by bucket) b using (bucket),
    (select coalesce(sum(n), 0)::bigint as sum_s from doc_words), (select coalesce(sum(n), 0)::bigint as sum_t from target_words)
),
weights as (
    select rid, cast(floor(sum(n * gain)::double / sum(n)) as bigint) as weight from doc_words join buckets using (word) join gains using (bucket) group by rid
),
scored as materialized (
    select rid, doc_id, cast(len(words) as bigint) as n_features, coalesce(weight, 0) as weight,
        coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) + 0.5) / 4294967296))) as bigint) as score
    from docs left join weights using (rid)
),
drawn as (
    select rid, row_number() over (order by score desc, doc_id nulls last, n_features, rid) as rank from scored where n_features >= 20
    qualify rank <= (select 10 * count(*) // 100 from scored where n_features >= 20)
)
select doc_id, n_features, weight, score, rank, n_features as n_words from scored left join drawn using (rid)
"""

SQL = {"op3_decontaminate": CONTAMINATION, "op5_hamming": HAMMING, "op11_hard_negatives": NEGATIVES, "op12_resample": RESAMPLE}
