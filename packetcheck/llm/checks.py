"""The queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from packetcheck.llm import embeddings, infill, mixing, secrets, url_rules


def secret_scans() -> str:
    """Spans by pattern, their values' owners, and the live ones."""
    parts = []
    for no, (kind, pattern, group, least) in enumerate(secrets.KINDS):
        p = "'" + pattern.replace("'", "''") + "'"
        parts.append(f"""
            select doc_id, owner, key, '{kind}' as kind, {no} as no, {least} as least, regexp_extract_all(text, {p}) as m,
                   regexp_extract_all(text, {p}, {group}) as g, string_split_regex(text, {p}) as p from docs""")
    return f"""
    with docs as (
        select doc_id, coalesce(text, '') as text, md5(coalesce(text, '')) as key, coalesce('source ' || source, 'doc ' || coalesce(doc_id, '')) as owner
        from documents
    ),
    matched as ({' union all '.join(parts)}),
    numbered as (select *, unnest(range(1, len(m) + 1)) as i from matched),
    spans as (
        select doc_id, owner, key, kind, no, len(m[i]) as size, g[i] as value,
               list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) as start
        from numbered where len(g[i]) >= least
    ),
    owners as (select value, count(distinct owner) as n, count(distinct key) as texts from spans group by value),
    base as (
        select doc_id, count(*) filter (no = 0) as n_assign, count(*) filter (no = 1) as n_access, count(*) filter (no = 2) as n_hex,
               string_agg(kind || ':' || start || ':' || start + size, ',' order by start, no) as listed
        from (select doc_id, kind, no, cast(start as bigint) as start, size from spans) group by doc_id
    ),
    every as (
        select doc_id, kind, no, cast(start as bigint) as start, size from spans
        union all
        select doc_id, '{secrets.LIVE}', {len(secrets.KINDS)}, cast(start as bigint), size
        from spans join owners on owners.value = spans.value where n <= {secrets.OWNERS} or texts <= {secrets.TEXTS}
    ),
    listed as (
        select doc_id, string_agg(kind || ':' || start || ':' || start + size, ',' order by start, no) as spans from every group by doc_id
    )
    select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
           sha256(coalesce(base.listed, '')) as base_sha256, coalesce(listed.spans, '') as spans
    from documents d left join base on base.doc_id = d.doc_id left join listed on listed.doc_id = d.doc_id
    """


def embedding_links() -> str:
    """All pairs of a label, compared in double precision."""
    return f"""
    with recursive vectors as (
        select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings
    ),
    usable as (
        select *, sqrt(list_dot_product(v, v)) as norm from vectors
        where label is not null and len(v) > 0 and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
              and len(list_filter(v, lambda x: x <> 0)) > 0
    ),
    links as (
        select a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v)
        where list_dot_product(a.v, b.v) / (a.norm * b.norm) >= {embeddings.THRESHOLD}
    ),
    reached as (
        select vec_id as a, vec_id as b from vectors
        union
        select r.a, l.b from reached r join links l on l.a = r.b
    ),
    named as (select a as vec_id, min(b) as component_id from reached group by a),
    counted as (select a as vec_id, count(*) as n from links group by a)
    select v.vec_id, coalesce(n, 0) as n_links, component_id, v.vec_id = component_id as kept
    from vectors v join named on named.vec_id = v.vec_id left join counted on counted.vec_id = v.vec_id
    """


def url_verdicts(rules: list[tuple[str, str]]) -> str:
    """Fixed rules by length; mined ones from all token subsets of the labelled urls."""
    def part(k: int) -> str:
        return f"regexp_extract(coalesce(url, ''), '{url_rules._URL}', {k})"

    def fits(rule: str) -> str:
        own, _, rest = rule.partition("/")
        return f"(host = '{own}' or ends_with(host, '.{own}')) and starts_with(path, '/{rest}')"

    longest = sorted(rules, key=lambda x: -len(x[1]))
    rule = " ".join(f"when {fits(r)} then '{r}'" for _, r in longest)
    verdict = " ".join(f"when {fits(r)} then '{v}'" for v, r in longest)

    def marked(mark: str, values: str) -> str:
        return f"list_transform(list_filter({values}, lambda x: x <> ''), lambda x: '{mark} ' || x)"

    d = url_rules.DEVIATIONS
    d2 = d * d
    segments = "list_transform(string_split(lower(path), '/'), lambda x: regexp_replace(x, '\\.[a-z0-9]+$', ''))"
    return f"""
    with parts as (
        select page_id, url, translate({part(1)}, '{url_rules._CAPITALS}', '{url_rules._SMALL}') as host, {part(2)} as path,
               {part(3)} as query, {part(4)} as mark from pages
    ),
    tokened as (
        select *, list_sort(list_distinct(list_concat(
            {marked('host', "string_split(host, '.')")},
            {marked('path', f"list_filter({segments}, lambda x: not regexp_full_match(x, '[0-9]*'))")},
            {marked('file', "[regexp_extract(lower(path), '\\.([a-z0-9]+)$', 1)]")},
            {marked('key', "list_transform(string_split(lower(query), '&'), lambda x: regexp_extract(x, '^([^=]*)', 1))")},
            {marked('mark', '[mark]')}))) as tokens,
            try_cast(regexp_extract(path, '/([0-9]{{1,18}})(?:[/.]|$)', 1) as bigint) as doc_id
        from parts
    ),
    known as (
        select doc_id, bool_or(coalesce(quality, 1) = 0 or coalesce(toxic, 0) = 1) as bad from labels group by doc_id
    ),
    labelled as (select tokens, bad from tokened join known on known.doc_id = tokened.doc_id where len(tokens) > 0),
    masks as (select tokens, bad, unnest(range(1, cast(power(2, len(tokens)) as bigint))) as mask from labelled),
    subsets as (
        select list_filter(tokens, lambda x, i: (mask >> (i - 1)) % 2 = 1) as subset, count(*) as n, count(*) filter (bad) as n_bad
        from masks group by 1
    ),
    mined as (
        select subset from (select subset, n_bad, cast(n as double) as n, n_bad / cast(n as double) as c from subsets)
        where n_bad >= {url_rules.MIN_COUNT} and c >= {url_rules.MIN_CONFIDENCE}
              and (c + {d2} / (2 * n) - {d} * sqrt(c * (1 - c) / n + {d2} / (4 * n * n))) / (1 + {d2} / n)
                  > (select count(*) filter (bad) / cast(count(*) as double) from labelled)
    ),
    blocked as (select distinct tokens from tokened join mined on list_has_all(tokens, subset))
    select page_id, host, path, case {rule} end as rule,
           case {verdict} when blocked.tokens is not null then '{url_rules.BLOCK}' else '{url_rules.ALLOW}' end as verdict
    from tokened left join blocked on blocked.tokens = tokened.tokens
    """


def source_mixing() -> str:
    """Targets, all quotients in one order, and blocks by their places."""
    block, seed = mixing.BLOCK, mixing.SEED
    weights = "[" + ", ".join(f"{float(x)}" for x in mixing.WEIGHTS) + "]"

    def number(text: str) -> str:
        return f"cast('0x' || substr(md5({text}), 1, 15) as bigint)"

    def picked(at: str) -> str:
        return f"(({at}) * picked + phase) // blocks"

    def before(position: str) -> str:
        at = f"(({position}) // {block})"
        return f"({block} * ({picked(at)}) + (({position}) - {block} * {at}) * ({picked(at + ' + 1')} - {picked(at)}))"

    return f"""
    with docs as (
        select doc_id, source, coalesce('+' || source, '-') as key,
               cast(len(regexp_extract_all(coalesce(text, ''), '{mixing.WORD}')) as bigint) as size,
               {number(f"'{seed}:' || coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))")} as drawn
        from documents
    ),
    sources as (select source, key, cast(sum(size) as bigint) as words from docs group by source, key),
    weighed as (
        select key, words, words * {float(mixing.MOST)} as bound,
               ({weights})[1 + (row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)}] as weight from sources
    ),
    shared as (
        select *, sum(bound) over o as bounds, sum(weight) over o as weights,
               {mixing.SHARE} * sum(words) over () as total, sum(weight) over () as all_weights
        from weighed window o as (order by bound / weight, key rows between unbounded preceding and current row)
    ),
    reached as (select *, bound * (all_weights - weights + weight) <= weight * (total - bounds + bound) as full_ from shared),
    rest as (
        select (any_value(total) - coalesce(sum(bound) filter (full_), 0)) / greatest(any_value(all_weights) - coalesce(sum(weight) filter (full_), 0), 1e-300) as rest_
        from reached
    ),
    aimed as (
        select key, words, case when full_ then bound else weight * rest_ end as target,
               greatest(1, cast(ceil(words / {float(mixing.SHARD)}) as bigint)) as shards
        from reached, rest
    ),
    seat as (
        select key, target / (2 * k - 1) as quotient, k
        from (select key, target, unnest(range(1, cast(2 * target / {block} as bigint) + 3)) as k from aimed where target > 0)
    ),
    quotas as (
        select key, count(*) as seats from (select key, row_number() over (order by quotient desc, key, k) as place from seat)
        where place <= (select round_even(sum(target) / {block}, 0) from aimed) group by key
    ),
    dealt as (select d.*, a.words as source_size, a.target, d.drawn % a.shards as shard from docs d join aimed a on a.key = d.key),
    cells as (select key, shard, cast(sum(size) as bigint) as words, greatest(1, cast(ceil(sum(size) / {float(block)}) as bigint)) as blocks from dealt group by key, shard),
    cell_seat as (
        select c.key, shard, seats, words / (2 * k - 1) as quotient, k
        from (select *, unnest(range(1, 4 * blocks + 3)) as k from cells where words > 0) c join quotas q on q.key = c.key
    ),
    given as (
        select key, shard, count(*) as quota
        from (select *, row_number() over (partition by key order by quotient desc, shard, k) as place from cell_seat) where place <= seats
        group by key, shard
    ),
    clipped as (
        select c.key, c.shard, blocks, least(coalesce(quota, 0), {mixing.MOST} * blocks) as quota,
               {number(f"'{seed}:' || c.key || ':' || c.shard")} % blocks as phase
        from cells c left join given g on g.key = c.key and g.shard = c.shard
    ),
    placed as (
        select d.*, c.quota // c.blocks as passes, c.quota % c.blocks as picked, c.blocks, c.phase,
               cast(sum(size) over (partition by d.key, d.shard order by drawn, doc_id nulls first rows between unbounded preceding and current row) as bigint) - size as start
        from dealt d join clipped c on c.key = d.key and c.shard = d.shard
    )
    select doc_id, size, source_size, target, cast(passes * size + {before("start + size")} - {before("start")} as bigint) as taken from placed
    """


def fill_in_middle() -> str:
    """Units by pattern, cut and joined as lists."""
    def drawn(k: int) -> str:
        return f"cast('0x' || substr(sha256('{infill.SEED}:' || coalesce(cast(doc_id as varchar), '')), {8 * k + 1}, 8) as bigint)"

    marked = " or ".join(f"contains(text, '{x}')" for x in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))
    return f"""
    with units as (
        select doc_id, coalesce(text, '') as text, {", ".join(f"{drawn(k)} as h{k + 1}" for k in range(4))},
               regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u
        from documents
    ),
    cuts as (
        select *, len(u) as n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b,
               case when text = '' or {marked} or h3 % 100 >= {infill.SHARE} then '{infill.PLAIN}'
                    when h4 % 100 < {infill.SUFFIX_FIRST} then '{infill.SPM}' else '{infill.PSM}' end as form
        from units
    ),
    parts as (
        select *, array_to_string(u[1:a], '') as prefix, array_to_string(u[a + 1:b], '') as middle, array_to_string(u[b + 1:], '') as suffix from cuts
    ),
    outputs as (
        select *, case form when '{infill.PLAIN}' then text when '{infill.PSM}' then '{infill.PREFIX}' || prefix || '{infill.SUFFIX}' || suffix || '{infill.MIDDLE}' || middle
                  else '{infill.SUFFIX}' || suffix || '{infill.PREFIX}' || prefix || '{infill.MIDDLE}' || middle end as output
        from parts
    )
    select doc_id, n, form, case when form <> '{infill.PLAIN}' then length(prefix) end as prefix_chars,
           case when form <> '{infill.PLAIN}' then length(middle) end as middle_chars, sha256(output) as output_sha256,
           sha256(case when form = '{infill.PLAIN}' then output else prefix || middle || suffix end) as restored_sha256
    from outputs
    """
