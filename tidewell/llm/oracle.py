"""SQL for DuckDB of those queries of this subpackage that SQL can express."""

from __future__ import annotations

import numpy as np

from . import shared, substring_dedup, url_filter

#: Words of a text as a list: maximal runs without the six separators.
WORDS = r"list_filter(string_split_regex(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def near_dup_sql(percent: int = 80) -> str:
    """All pairs by a join on shingles of two words, and components by the closure of the links."""
    words = WORDS.format(text=f"translate(text, '{shared.UPPER}', '{shared.LOWER}')")
    return f"""
        with recursive words as (select doc_id, {words} as ws from documents),
        sets as (
            select doc_id, case when len(ws) < 2 then ws else list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) end as s
            from words),
        shingles as (select doc_id, unnest(s) as x from sets),
        common as (
            select a.doc_id as a, b.doc_id as b, count(*) as n
            from shingles a join shingles b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
        links as (
            select c.a, c.b from common c join sets p on p.doc_id = c.a join sets q on q.doc_id = c.b
            where 100 * c.n >= {percent} * (len(p.s) + len(q.s) - c.n)),
        edges as (select a, b from links union all select b, a from links),
        reach(id, other) as (
            select doc_id, doc_id from sets
            union
            select r.id, e.b from reach r join edges e on e.a = r.other),
        roots as (select id, min(other) as root from reach group by id)
        select s.doc_id, cast(len(s.s) as bigint) as n_shingles, r.root as component_id, s.doc_id = r.root as kept
        from sets s join roots r on r.id = s.doc_id
    """


def substring_sql(window: int = substring_dedup.WINDOW) -> str:
    """Every window with the smallest id that has it; words under windows of others are left out."""
    return f"""
        with words as (select row_number() over () as row, doc_id, {WORDS.format(text="text")} as ws from documents),
        windows as (
            select row, doc_id, unnest(range(1, len(ws) - {window - 2})) as start,
                   unnest(list_transform(range(1, len(ws) - {window - 2}), lambda i: array_to_string(ws[i:i + {window - 1}], ' '))) as x
            from words where len(ws) >= {window}),
        first as (select x, min(doc_id) as id from windows group by x),
        gone as (
            select distinct row, unnest(range(w.start, w.start + {window})) as place
            from windows w join first f on f.x = w.x where f.id < w.doc_id),
        lists as (select row, list(place) as places from gone group by row),
        kept as (
            select w.doc_id, w.ws, list_filter(w.ws, lambda x, i: l.places is null or not list_contains(l.places, i)) as ks
            from words w left join lists l on l.row = w.row)
        select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - len(ks) as bigint) as n_removed,
               sha256(array_to_string(ks, ' ')) as kept_sha256
        from kept
    """


def crc32_table() -> list[int]:
    """The remainders of all bytes for the reversed polynomial EDB88320."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def url_weights() -> tuple[np.ndarray, float]:
    """The url model by gradient descent on weights, with Python's own crc32."""
    import zlib

    x = np.zeros((len(url_filter.LABELLED), url_filter.BUCKETS))
    for row, (url, _) in zip(x, url_filter.LABELLED, strict=True):
        host, _, path = url.partition("://")[2].partition("/")
        for text in (f"^{host}$", f"~/{path}$"):
            for k in range(len(text) - url_filter.GRAM + 1):
                row[zlib.crc32(text[k : k + url_filter.GRAM].encode()) % url_filter.BUCKETS] += 1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y, w, bias = np.array([label for _, label in url_filter.LABELLED], float), np.zeros(url_filter.BUCKETS), 0.0
    for _ in range(url_filter.STEPS):
        error = y - 1 / (1 + np.exp(-(x @ w + bias)))
        w = w * (1 - url_filter.RATE * url_filter.RIDGE) + url_filter.RATE * (error @ x)
        bias += url_filter.RATE / len(y) * error.sum()
    return w, float(bias)


def url_sql() -> str:
    """Rules by comparison, the model's weights as a table, grams and their checksums in SQL."""
    w, bias = url_weights()
    weights = ", ".join(f"({k}, {float(v)!r}::double)" for k, v in enumerate(w))
    rules = ", ".join(f"('{rule}', '{rule.partition('/')[0]}', '/{rule.partition('/')[2]}', '{verdict}')" for rule, verdict in url_filter.RULES)
    n = url_filter.GRAM
    grams = f"case when length(s) < {n} then [s] else list_transform(range(1, length(s) - {n - 2}), lambda i: substr(s, i, {n})) end"
    byte_list = "list_transform(range(0, cast(length(hex(encode(g))) / 2 as bigint)), lambda i: cast('0x' || substr(hex(encode(g)), 2 * i + 1, 2) as bigint))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {byte_list}), lambda c, b: xor(c >> 8, {crc32_table()}[(xor(c, b) & 255) + 1])), 4294967295)"
    return f"""
        with urls as (
            select page_id, row_number() over () as row,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{shared.UPPER}', '{shared.LOWER}') as host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
            from pages),
        rules(rule, host, prefix, verdict) as (values {rules}),
        best as (
            select u.row, min_by(r.rule, (-length(r.rule), r.rule)) as rule, min_by(r.verdict, (-length(r.rule), r.rule)) as verdict
            from urls u join rules r on (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.prefix) group by u.row),
        parts as (
            select row, '^' || host || '$' as s from urls where host <> ''
            union all select row, '~' || path || '$' from urls where path <> ''),
        grams as (select row, unnest({grams}) as g from parts),
        codes as (select g, {crc} % {url_filter.BUCKETS} as b from (select distinct g from grams)),
        counts as (select g.row, c.b, count(*) as n from grams g join codes c on c.g = g.g group by 1, 2),
        weights(b, w) as (values {weights}),
        sums as (select c.row, sum(c.n * w.w) / sqrt(sum(c.n * c.n)) as z from counts c join weights w on w.b = c.b group by c.row),
        scores as (select u.*, 1 / (1 + exp(-({bias!r}::double + coalesce(s.z, 0)))) as p from urls u left join sums s on s.row = u.row)
        select s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, case when s.p >= 0.5 then 'block' else 'allow' end) as verdict, round(s.p, 6) as score
        from scores s left join best b on b.row = s.row
    """


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": url_sql(), "op3_near_dup": near_dup_sql(), "op4_substring_dedup": substring_sql()}
