"""SQL for the registered queries that SQL can express, over the same tables."""

from __future__ import annotations

_PAGES = """
    select page_id, coalesce(url, '') as url, coalesce(html, '') as payload, strlen(coalesce(html, '')) as payload_bytes,
        sha1(coalesce(html, '')) as payload_digest
    from pages
"""

ORACLE: dict[str, str] = {
    "op5_warc": f"""
        with captured as ({_PAGES}),
        shared as (
            select payload_digest, max(page_id) as response from captured where payload_bytes >= 1000 group by payload_digest
        ),
        keyed as (
            select *, regexp_replace(regexp_replace(lower(url), '#.*$', ''), '^[a-z][a-z0-9+.-]*://(www[0-9]*\\.)?', '') as plain
            from captured
        ),
        parted as (
            select *, regexp_extract(plain, '^([^/?:]*)', 1) as host, regexp_replace(plain, '^[^/?:]*(:[0-9]*)?', '') as rest from keyed
        ),
        indexed as (
            select parted.*, response,
                case when plain = '' then '' else array_to_string(list_reverse(string_split(host, '.')), ',') || ')'
                    || case when starts_with(rest, '/') then rest else '/' || rest end end as url_key,
                strftime(make_timestamp((1704067200 + page_id % 1000000000) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as captured
            from parted left join shared using (payload_digest)
        )
        select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
            case when payload_bytes < 1000 or page_id = response then 'response' else 'revisit' end as record_type,
            case when payload_bytes < 1000 or page_id = response then null else response end as refers_to,
            url_key, captured,
            (row_number() over (order by encode(url_key), captured, page_id) - 1)::bigint as position
        from indexed
    """,
    "op8_topk": """
        with whole as (
            select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v
            from embeddings
            where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
        ),
        scored as (
            select q.vec_id as query_id, c.vec_id as vec_id,
                list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
            from whole q join whole c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)
        ),
        ranked as (
            select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored
        )
        select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 20
    """,
    "op9_jaccard": """
        with recursive worded as (
            select doc_id, list_filter(
                string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\x09-\\x0D]+'),
                lambda w: w <> '') as words
            from documents
        ),
        sets as (
            select doc_id, case
                when words is null or len(words) = 0 then []
                when len(words) < 3 then [array_to_string(words, ' ')]
                else list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]))
                end as shingles
            from worded
        ),
        sized as (select doc_id, len(shingles) as n from sets),
        exploded as (select doc_id, hash(shingle) as h from (select doc_id, unnest(shingles) as shingle from sets)),
        shared as (
            select a.doc_id as a, b.doc_id as b, count(*) as m
            from exploded a join exploded b on a.h = b.h and a.doc_id < b.doc_id group by all
        ),
        linked as (
            select a, b from shared join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * m >= 90 * (x.n + y.n - m)
        ),
        edges as (select a, b from linked union all select b, a from linked),
        reached as (
            select doc_id as origin, doc_id as met from sized
            union
            select origin, b from reached join edges on a = met
        )
        select origin as doc_id, n::bigint as n_shingles, min(met) as component_id
        from reached join sized on sized.doc_id = origin group by origin, n
    """,
    "op12_divergence": """
        with read as (
            select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text, row_number() over () as r
            from documents
        ),
        worded as (
            select r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) as term from read
        ),
        kept as (select lang, term from worded group by lang, term having count(distinct r) >= 30),
        sizes as (select lang, count(*) as v from kept group by lang),
        groups as (select distinct lang, source from read),
        counted as (select lang, source, term, count(*) as c from worded semi join kept using (lang, term) group by all),
        totals as (
            select lang, source, coalesce(n, 0) as n, coalesce(v, 0) as v from groups
            left join (select lang, source, sum(c) as n from counted group by all) using (lang, source) left join sizes using (lang)
        ),
        every as (
            select lang, source, term, coalesce(c, 0) as c,
                (1 + (1000000000::hugeint * (coalesce(c, 0) + 5)) // (n + 5 * v))::bigint as p
            from totals join kept using (lang) left join counted using (lang, source, term)
        ),
        whole as (select lang, sum(n) as n, any_value(v) as v from totals group by lang),
        quoted as (
            select lang, term, (1 + (1000000000::hugeint * (sum(c) + 5)) // (any_value(n) + 5 * any_value(v)))::bigint as q
            from every join whole using (lang) group by lang, term
        ),
        apart as (
            select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
            from every a join every b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        ),
        found as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
            from groups a join groups b on a.lang = b.lang and a.source <> b.source
            left join apart on apart.lang = a.lang and apart.source = a.source and apart.item = b.source
            union all
            select lang, source, 'term', term, p - q from every join quoted using (lang, term) where c > 0 and p > q
        )
        select lang, source, part, item, value, rank::integer as rank from (
            select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from found
        ) where part = 'pair' or rank <= 50
    """,
}
