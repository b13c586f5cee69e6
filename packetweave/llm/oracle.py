"""DuckDB SQL for the registered queries that SQL can state.

Written from the contracts, with plain patterns where the operators use
possessive ones, so that the two sides share no code.
"""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"


def _spans(kind: str, pattern: str, keep: str, place: int) -> str:
    """Rows (doc_id, place, kind, start, stop, hit) of one kind over ``texts``."""
    quoted = pattern.replace("'", "''")
    return f"""
    select doc_id, row_key, {place} as place, '{kind}' as kind, stop - length(hit) as start, stop, hit
    from (select doc_id, row_key, unnest(hits) as hit, unnest(ends) as stop
          from (select doc_id, row_key, hits, list_transform(range(1, len(hits) + 1), lambda i:
                         list_sum(list_transform(wholes[1:i], lambda w: length(w)))::BIGINT) as ends
                from (select doc_id, row_key, regexp_extract_all(text, '(?s)(.*?)({quoted})', 2) as hits,
                             regexp_extract_all(text, '(?s)(.*?)({quoted})', 0) as wholes
                      from texts) where len(hits) > 0))
    where {keep}"""


def _digest(parts: list[str], kinds: tuple[str, ...], order: str) -> str:
    counts = ", ".join(f"count(*) filter (where kind = '{k}') as n_{k}" for k in kinds)
    named = ", ".join(f"'{k}'" for k in kinds)
    label = "kind || ':' || start || ':' || stop"
    return f"""
with texts as (select doc_id, row_number() over () as row_key, coalesce(text, '') as text from documents),
spans as ({" union all ".join(parts)})
select t.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in kinds)},
       sha256(coalesce(base, '')) as base_sha256, coalesce(listed, '') as spans
from texts t left join (
  select row_key, {counts},
         string_agg({label}, ',' order by {order}) filter (where kind in ({named})) as base,
         string_agg({label}, ',' order by {order}) as listed
  from spans group by row_key) s using (row_key)"""


ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
VALUE = r"""(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

OP8 = _digest([
    _spans("assign", ASSIGN, f"length(regexp_extract(hit, '{VALUE}', 1)) >= 6", 0),
    _spans("access", "AKIA[A-Z0-9]+", "length(hit) >= 20", 1),
    _spans("hex", "[0-9a-f]+", "length(hit) >= 24", 2),
    _spans("pem", "-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", "true", 3),
    _spans("github", r"\bgh[opsur]_[A-Za-z0-9]{36,}", "true", 4),
    _spans("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}", "true", 5),
], ("assign", "access", "hex"), "start, place")

_DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
_LUHN = f"""case when length({_DIGITS}) between 16 and 19 then
  list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
    case when i % 2 = 1 then reverse({_DIGITS})[i]::INT
         when reverse({_DIGITS})[i]::INT > 4 then reverse({_DIGITS})[i]::INT * 2 - 9
         else reverse({_DIGITS})[i]::INT * 2 end)) % 10 = 0 else false end"""
_PARTS = "list_bool_and(list_transform(string_split(hit, '.'), lambda p: ltrim(p, '0') = '' or (length(ltrim(p, '0')) <= 3 and try_cast(ltrim(p, '0')[1:3] as INT) <= 255)))"
_PACKED = "replace(hit, ' ', '')"
_TURNED = f"({_PACKED}[5:] || {_PACKED}[1:4])"
_MOD97 = f"""length({_PACKED}) between 15 and 34 and list_reduce(list_transform(range(1, length({_TURNED}) + 1), lambda i:
    case when {_TURNED}[i] between '0' and '9' then ascii({_TURNED}[i]) - 48 else ascii({_TURNED}[i]) - 55 end),
    lambda a, n: (a * case when n > 9 then 100 else 10 end + n) % 97) = 1"""

OP10 = _digest([
    _spans("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", 0),
    _spans("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", _PARTS, 1),
    _spans("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN, 2),
    _spans("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 8 and 15", 3),
    _spans("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _MOD97, 4),
], ("email", "ip", "card", "phone"), "place, start")


def _apportion(name: str, rows: str, by: str, key: str, weight: str, seats: str, keep: str) -> str:
    return f"""
{name}_0 as (select *, count(*) over w as n_, sum({weight}) over w as w_ from ({rows}) window w as (partition by {by})),
{name}_1 as (select *, case when w_ > 0 then {weight}::DOUBLE / w_ else 0.0 end as share_ from {name}_0),
{name}_2 as (select *, case when {seats} > n_ and w_ > 0
   then floor(greatest({seats} - n_, 0)::DOUBLE * share_ + 0.5)::BIGINT else 0 end as base_ from {name}_1),
{name}_3 as (select *, {seats} - sum(base_) over (partition by {by}) as left_ from {name}_2),
{name}_4 as (select *, {weight}::DOUBLE / (2 * (base_ + j_) + 1) as q_
   from (select *, unnest(range(0, ceil(1.5 * n_ * share_)::BIGINT + 2)) as j_ from {name}_3)),
{name}_5 as (select *, row_number() over (partition by {by} order by q_ desc, {key}, j_) as rank_ from {name}_4),
{name} as (select {keep}, any_value(base_) + count(*) filter (where rank_ <= left_ and w_ > 0) as quota
   from {name}_5 group by {keep})"""


def _draw(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


OP2 = f"""
with sizes as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as size,
    {_draw("'42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))")} as draw from documents),
sources as (select *, [5.0, 2.0, 1.0][(place - 1) % 3 + 1]::DOUBLE as weight, source_size * 2.0::DOUBLE as cap from (
    select source, sum(size)::BIGINT as source_size, row_number() over (order by source nulls last) as place from sizes group by source)),
levels as (select *, (sum(source_size) over () * 1.5::DOUBLE - coalesce(sum(cap) over (order by cap / weight, place
      rows between unbounded preceding and 1 preceding), 0)) /
      sum(weight) over (order by cap / weight, place rows between current row and unbounded following) as level,
    row_number() over (order by cap / weight, place) as pos from sources),
found as (select arg_min(level, pos) as level from levels where level <= cap / weight),
targets as (select source, source_size, place, least(cap, found.level * weight) as target from sources, found),
placed as (select s.*, t.source_size, t.place, t.target,
    draw % greatest(ceil(t.source_size / 262144.0)::BIGINT, 1) as shard from sizes s join targets t on s.source is not distinct from t.source),
shards as (select place, shard // 1024 as shard_group, shard, sum(size)::BIGINT as shard_size from placed group by all),
{_apportion("by_source", "select *, 0 as all_, round(sum(target) over () / 16)::BIGINT as seats from targets", "all_", "place", "target", "seats", "place")},
{_apportion("by_group", "select place, shard_group, g.group_size, quota as source_quota from (select place, shard_group, sum(shard_size)::BIGINT as group_size from shards group by all) g join by_source using (place)",
            "place", "shard_group", "group_size", "source_quota", "place, shard_group")},
{_apportion("by_shard", "select place, shard_group, shard, shard_size, quota as group_quota from shards join by_group using (place, shard_group)",
            "place, shard_group", "shard", "shard_size", "group_quota", "place, shard, shard_size")},
line as (select p.*, greatest(ceil(shard_size / 16.0)::BIGINT, 1) as blocks, quota as given,
    coalesce(sum(size) over (partition by place, shard order by draw, doc_id rows between unbounded preceding and 1 preceding), 0)::BIGINT as a
    from placed p join by_shard using (place, shard)),
drawn as (select *, least(given, 2 * blocks) as q, a + size as b, {_draw("'42:' || place || ':' || shard")} % blocks as r from line)
select doc_id, size, source_size, target,
   (((b // 16) * q + r) // blocks * 16 + ((((b // 16) + 1) * q + r) // blocks - ((b // 16) * q + r) // blocks) * (b % 16)
  - (((a // 16) * q + r) // blocks * 16 + ((((a // 16) + 1) * q + r) // blocks - ((a // 16) * q + r) // blocks) * (a % 16)))::BIGINT as taken
from drawn"""


OP3 = """
with v as (select vec_id, row_number() over () as k, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) as c from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select q.k, q.vec_id as query_id, c.vec_id, list_inner_product(q.c, c.c)::BIGINT as score
  from v q join v c on q.vec_id % 20 = 0 and q.k <> c.k and len(q.c) = len(c.c)),
ranked as (select *, row_number() over (partition by k order by score desc, vec_id) as place from pairs)
select query_id, place::INTEGER as rank, vec_id, score from ranked where place <= 20"""

_FOLDED = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP4 = f"""
with items as (select coalesce(item_id::VARCHAR, 'null') as item_id, {_FOLDED} as words from benchmark),
windows as (
  select item_id, 13 as n, array_to_string(words[i:i + 12], ' ') as win
  from (select item_id, words, unnest(range(1, len(words) - 11)) as i from items where len(words) >= 13)
  union all select item_id, len(words), array_to_string(words, ' ') from items where len(words) between 1 and 12),
docs as (select row_number() over () as k, doc_id, {_FOLDED} as words from documents),
places as (select k, n, p, array_to_string(words[p:p + n - 1], ' ') as win
  from (select k, words, n, unnest(range(1, len(words) - n + 2)) as p from docs, (select distinct n from windows))),
hits as (select k, places.n, p, item_id from places join windows on places.n = windows.n and places.win = windows.win),
marked as (select k, count(distinct w) as n_hit from (select k, unnest(range(p, p + n)) as w from hits) group by k),
found as (select k, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by k)
select doc_id, len(words) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * n_hit >= len(words) as contaminated
from docs left join marked using (k) left join found using (k)"""

OP9 = """
with rows as (select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hexed from pages),
firsts as (select payload, min(page_id) as first from rows group by payload)
select page_id, strlen(payload) as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    ((('0x' || substr(hexed, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') as payload_digest,
  case when page_id is distinct from first and first is not null then 'revisit' else 'response' end as record_type,
  case when page_id is distinct from first then first end as refers_to
from rows join firsts using (payload)"""

_MEASURES = {"word_length": (1024, True), "symbol_share": (64, False), "line_share": (341, False), "repeat_share": (256, False)}


def _fence_rows(name: str, sketch: str, by: str) -> str:
    """Quartile buckets of each group turned into (by, m, low, high)."""
    spread = " ".join(f"when '{m}' then {least}" for m, (least, _) in _MEASURES.items())
    return f"""
{name}_cum as (select *, sum(n) over (partition by {by}, m order by b) as upto, sum(n) over (partition by {by}, m) as every from {sketch}),
{name}_quart as (select {by}, m, min(b) filter (where 4 * upto >= every) as q1, min(b) filter (where 4 * upto >= 3 * every) as q3 from {name}_cum group by {by}, m),
{name}_ends as (select *, case when q1 < 64 then q1 else (q1 - 32 * (q1 // 32 - 1)) << (q1 // 32 - 1) end as lowest,
    case when q3 < 64 then q3 else ((q3 - 32 * (q3 // 32 - 1) + 1) << (q3 // 32 - 1)) - 1 end as highest from {name}_quart),
{name} as (select {by}, m, case when m = 'word_length' then lowest - reach end as low, highest + reach as high
  from (select *, 6 * greatest(highest - lowest, case m {spread} end) as reach from {name}_ends))"""


OP11 = f"""
with texts as (select row_number() over () as k, doc_id, lang, source, coalesce(text, '') as t from documents),
parts as (select *, regexp_extract_all(t, '{WORDS}') as w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls from texts),
wins as (select k, i, count(*) over (partition by k, a, b, c) as times from (
  select k, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select k, w, unnest(range(1, len(w) - 1)) as i from parts))),
reps as (select k, count(distinct p) as n_repeat_words from (select k, unnest([i, i + 1, i + 2]) as p from wins where times > 1) group by k),
counts as (select k, doc_id, lang, source, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT as word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT as n_symbols, len(ls) as n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words from parts left join reps using (k)),
rows as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    case when n_words > 0 then word_chars * 4096 // n_words else 0 end as word_length, case when n_words > 0 then n_symbols * 4096 // n_words else 0 end as symbol_share,
    case when n_lines > 0 then n_dup_lines * 4096 // n_lines else 0 end as line_share, case when n_words > 0 then n_repeat_words * 4096 // n_words else 0 end as repeat_share from counts),
long as ({" union all ".join(f"select k, lang, source, base_failed, '{m}' as m, {m} as v from rows" for m in _MEASURES)}),
shifted as (select *, greatest(length(bin(v)) - 6, 0) as s from long),
sketch as (select lang, source, m, s * 32 + (v >> s) as b, count(*) as n from shifted where not base_failed group by all),
by_lang as (select lang, m, b, sum(n)::BIGINT as n from sketch group by all),
{_fence_rows("own", "sketch", "lang, source")},
{_fence_rows("wide", "by_lang", "lang")},
limits as (select own.lang, own.source, own.m, least(own.low, wide.low) as low, greatest(own.high, wide.high) as high
  from own join wide on own.lang is not distinct from wide.lang and own.m = wide.m),
verdict as (select k, bool_and(coalesce(v >= low, true) and v <= high) as good from long join limits on long.lang is not distinct from limits.lang
  and long.source is not distinct from limits.source and long.m = limits.m group by k)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(good, true) as kept
from rows left join verdict using (k)"""


def _crc32(number: str) -> str:
    """Unsigned CRC-32 of the decimal digits of a number."""
    turn = "list_reduce(range(0, 8), lambda d, j: xor(d >> 1, 3988292384 * (d & 1)), xor(c, ascii(({text})[i + 1])::BIGINT))".format(text=f"{number}::VARCHAR")
    return f"xor(list_reduce(range(0, length({number}::VARCHAR)), lambda c, i: {turn}, 4294967295::BIGINT), 4294967295)"


def _leaf(text: str) -> str:
    field = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    return "sha256(" + " || ".join(field(x) for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"


def _tree(name: str, leaves: str) -> str:
    """Nodes (tree, level, i, digest, n) above (tree, i, digest, n)."""
    return f"""
{name} as (select tree, 0 as level, i, digest, n from {leaves}
  union all select tree, level + 1, i // 3, sha256(string_agg(digest, '' order by i)), (n + 2) // 3 from {name} where n > 1 group by tree, level, i // 3, n)"""


OP12 = f"""
with recursive rows as (select row_number() over () as k, *, case when {_crc32("doc_id")} % 2 = 0 then replace(text, chr(10), '') else text end as other from documents),
hashed as (select k, doc_id, source, {_leaf("text")} as leaf, {_leaf("other")} as altered from rows),
placed as (select *, row_number() over (partition by source order by doc_id nulls first, leaf, k) - 1 as i, count(*) over (partition by source) as n,
  dense_rank() over (order by source nulls first) - 1 as tree from hashed),
lowest as (select tree, i, leaf as digest, n from placed),
{_tree("nodes", "lowest")},
subroots as (select tree, digest from nodes where n = 1),
second as (select 0 as tree, tree as i, digest, (select count(*) from subroots) as n from subroots),
{_tree("upper", "second")},
root as (select digest from upper where n = 1),
steps as (
  select k, level, p.i // (3 ** level)::BIGINT % 3 as slot, list(s.digest order by s.i) as others
  from placed p join nodes s on s.tree = p.tree and s.n > 1 and s.i // 3 = p.i // (3 ** (level + 1))::BIGINT and s.i <> p.i // (3 ** level)::BIGINT group by all
  union all select k, 1000 + level, p.tree // (3 ** level)::BIGINT % 3, list(s.digest order by s.i)
  from placed p join upper s on s.n > 1 and s.i // 3 = p.tree // (3 ** (level + 1))::BIGINT and s.i <> p.tree // (3 ** level)::BIGINT group by all),
every as (
  select k, level, p.i // (3 ** level)::BIGINT % 3 as slot from placed p join (select distinct tree, level from nodes where n > 1) using (tree)
  union all select k, 1000 + level, p.tree // (3 ** level)::BIGINT % 3 from placed p, (select distinct level from upper where n > 1)),
paths as (select k, list({{'slot': slot, 'others': coalesce(others, [])}} order by level) as path from every left join steps using (k, level, slot) group by k),
told as (select k, doc_id, leaf, altered, tree, coalesce(path, []) as path from placed left join paths using (k)),
ended as (select *, list_reduce(path, lambda d, s: {{'slot': s.slot, 'others': [sha256(array_to_string(
    list_concat(list_concat(s.others[:s.slot], [d.others[1]]), s.others[s.slot + 1:]), ''))]}},
  {{'slot': 0::BIGINT, 'others': [altered]}}).others[1] as folded_root from told)
select doc_id, leaf, s.digest as subroot, r.digest as root,
  sha256(coalesce(array_to_string(list_transform(path, lambda x: coalesce(array_to_string(x.others, ''), '')), ''), '')) as proof_sha256,
  folded_root, folded_root = r.digest as verified
from ended join subroots s using (tree), root r"""


OP13 = f"""
with turns as (select conv_id, turn, coalesce(text, '') as text,
    sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) as digest from conversations where conv_id is not null),
own as (select conv_id, list(struct_pack(digest := digest, chars := length(text)::BIGINT) order by turn nulls first, digest) as ts from turns group by conv_id),
cut as (select conv_id, ts, {_crc32("conv_id")} % 6 as h from own),
rebuilt as (select c.conv_id, list_concat(coalesce(b.ts[1:h], []), c.ts[h + 1:]) as ts from cut c left join own b on b.conv_id = c.conv_id - c.conv_id % 100),
prefixes as (select conv_id, d as depth, sha256(array_to_string(list_transform(ts[1:d], lambda t: t.digest), '')) as node,
    case when d > 0 then sha256(array_to_string(list_transform(ts[1:d - 1], lambda t: t.digest), '')) end as parent,
    case when d > 0 then ts[d].chars else 0 end as chars, d = len(ts) as ends
  from (select conv_id, ts, unnest(range(0, len(ts) + 1)) as d from rebuilt)),
nodes as (select node, depth, parent, chars, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(conv_id::VARCHAR, ',' order by conv_id) filter (where ends), '') as ended from prefixes group by all),
kids as (select parent, count(*) as n_children from nodes where parent is not null group by parent),
full_nodes as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join kids on n.node = kids.parent),
-- Every node counts once for each of its ancestors: they are the prefixes of its smallest member up to its depth.
sums as (select p.node, count(*) filter (where n_children = 0) as n_leaves, sum((n_convs - 1) * n.chars)::BIGINT as saved_tokens
  from full_nodes n join prefixes p on p.conv_id = n.conv_id and p.depth <= n.depth group by p.node)
select n.conv_id, n.depth, q.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(n.ended) as ends_sha256
from full_nodes n join sums using (node) left join nodes q on q.node = n.parent"""


def statements() -> dict[str, str]:
    return {"op2_mix": OP2, "op3_topk": OP3, "op4_decontamination": OP4, "op8_secrets": OP8, "op9_warc": OP9, "op10_pii": OP10,
            "op11_quality": OP11, "op12_merkle": OP12, "op13_prefixes": OP13}
