"""DuckDB SQL for those operators that SQL can express."""

AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

WARC = """
with p as (select page_id, coalesce(html, '') h from pages),
q as (select page_id, h, strlen(h)::bigint payload_bytes, max(page_id) over (partition by h) target from p)
select page_id, payload_bytes, sha1(h) payload_digest,
  case when payload_bytes >= 1000 and page_id <> target then 'revisit' else 'response' end record_type,
  case when payload_bytes >= 1000 and page_id <> target then target end refers_to
from q
"""

# hex keeps bytes apart; a window starts at i (from 0) and is told by the digest of its bytes
REPEATS = """
with d as (select doc_id, lower(hex(encode(coalesce(text, '')))) hx, strlen(coalesce(text, ''))::bigint n from documents),
w as (select doc_id, i, md5(substr(hx, 2 * i + 1, 200)) k from (select doc_id, hx, unnest(range(greatest(n - 99, 0))) i from d)),
f as (select *, row_number() over (partition by k order by doc_id, i) nth from w),
g as (select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i) + 100, -1) fresh from f where nth > 1),
r as (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) run from g),
s as (select doc_id, run, min(i) a, max(i) + 100 b from r group by all),
t as (select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) from_, a, b, row_number() over (partition by doc_id order by a desc) = 1 last_ from s),
o as (select doc_id, sum(b - a)::bigint n_removed, count(*) n_spans, string_agg(substr(hx, 2 * from_ + 1, 2 * (a - from_)) || case when last_ then substr(hx, 2 * b + 1) else '' end, '' order by a) kept from t join d using (doc_id) group by 1)
select doc_id, n n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, hx))) kept_sha256 from d left join o using (doc_id)
"""

LEAKS = f"""
with d as (select doc_id, coalesce(regexp_extract_all(translate(text, {AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) ws from documents),
b as (select item_id, regexp_extract_all(translate(text, {AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') ws from benchmark where text is not null),
tw as (select distinct item_id, least(len(ws), 10) size, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') phrase from (select item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) i from b where len(ws) > 0)),
sizes as (select distinct size from tw),
dw as (select doc_id, i, size, array_to_string(ws[i:i + size - 1], ' ') phrase from (select doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) i from d, sizes)),
hits as (select doc_id, i, size, item_id from dw join tw using (size, phrase)),
words as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + size)) p from hits) group by 1),
items as (select doc_id, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) ids from hits group by 1)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""

NEAR = f"""
with recursive d as (select doc_id, coalesce(regexp_extract_all(translate(text, {AZ}), '[^\\x20\\x09-\\x0D]+'), []) ws from documents),
s as (select distinct doc_id, case when len(ws) < 4 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 3], ' ') end g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) i from d where len(ws) > 0)),
n as (select doc_id, count(*) n from s group by 1),
same as (select a.doc_id a, b.doc_id b, count(*) k from s a join s b using (g) where a.doc_id < b.doc_id group by all),
link as (select a, b from same join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
both_ as (select a, b from link union select b, a from link),
reach as (select a, b from both_ union select r.a, e.b from reach r join both_ e on e.a = r.b),
low as (select a doc_id, least(a, min(b)) c from reach group by a)
select doc_id, coalesce(n, 0) n_shingles, coalesce(c, doc_id) component_id, coalesce(c, doc_id) = doc_id kept from d left join n using (doc_id) left join low using (doc_id)
"""

# p: each group's share of each kept term, q: the language's
APART = f"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source, translate(coalesce(text, ''), {AZ}) t from documents),
w as (select r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) term from d),
c as (select lang, source, term, count(*) n, count(distinct r) docs from w group by all),
k as (select lang, term, sum(n)::hugeint n from c group by all having sum(docs) >= 30),
l as (select lang, count(*)::hugeint v, sum(n)::hugeint total from k group by 1),
g as (select distinct lang, source from d),
t as (select g.lang, g.source, coalesce(sum(c.n) filter (where k.term is not null), 0)::hugeint total from g left join c on c.lang = g.lang and c.source = g.source left join k on k.lang = c.lang and k.term = c.term group by all),
p as (select t.lang, t.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (t.total + 5 * l.v) p, 1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v) q
  from t join k on k.lang = t.lang join l on l.lang = t.lang left join c on c.lang = t.lang and c.source = t.source and c.term = k.term),
far as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p))::bigint f from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, 'pair' part, b.source item, coalesce(f, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join far on far.lang = a.lang and far.source = a.source and far.item = b.source),
terms as (select lang, source, 'term' part, term item, (p - q)::bigint as value from p where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int rank from (select * from pairs union all select * from terms))
select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 50
"""



def _codes() -> str:
    """Two rounds and the last assignment, written out; a part's components are told by their positions i."""
    out = """
with z as (select row_number() over (order by vec_id, embedding) r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) z from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as (select r, part, i, z[part * (len(z) // 16) + i] x from (select r, z, part, unnest(range(1, len(z) // 16 + 1)) i from (select r, z, unnest(range(16)) part from z))),
e0 as (select part, r - 1 k, i, x from x where r <= 64)"""
    for n in range(3):
        out += f""",
d{n} as (select r, part, k, sum((x.x - e.x) * (x.x - e.x))::bigint f from x join e{n} e using (part, i) group by all),
a{n} as (select r, part, min(f) f, arg_min(k, f * 1000 + k) k from d{n} group by all)"""
        if n < 2:
            out += f""",
s{n} as (select part, k, i, sum(x)::bigint s, count(*) c from a{n} join x using (r, part) group by all),
e{n + 1} as (select part, k, i, coalesce((s - ((s % c) + c) % c) // c, e.x) x from e{n} e left join s{n} using (part, k, i))"""
    return out + """,
c as (select r, string_agg(printf('%02x', k), '' order by part) code, sum(f)::bigint error from a2 group by 1)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, (select sha256(string_agg(x::varchar, ',' order by part, k, i)) from e2) codebooks_sha256 from c join z using (r)
"""


SQL = {"op11_codes": _codes(), "op13_divergence": APART, "op5_warc": WARC, "op6_suffix_array": REPEATS, "op9_positional_index": LEAKS, "op10_minhash": NEAR}
