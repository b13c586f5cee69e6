"""Plain SQL for every query whose result SQL can state, on the same tables."""

from __future__ import annotations

from packetweave import schema as S
from packetweave.checks.views import duckdb_packets

ITERATIONS, CLUSTERS = 10, S.DEFAULT_CLUSTERS


def _flag(condition: str) -> str:
    return f"cast(coalesce({condition}, false) as int)"


def _number(column: str) -> str:
    return f"cast({column} as double)"


CLEAN = """
clean as (
  select {keys}frame_number, coalesce("timestamp", 0.0) as t, coalesce(src_ip, 'unknown') as src_ip,
    coalesce(dst_ip, 'unknown') as dst_ip, coalesce(protocol, 'unknown') as protocol,
    cast(coalesce(length, 0) as double) as length, coalesce(info, '') as info
  from packets)"""

# The patterns, words and protocol numbers of `schema`, as SQL.
EXT_LOCAL = r"^(192\.168\.|10\.|172\.(1[6-9]|2[0-9]|3[01])\.)"
EXT_FLAGS = {
    "src_local": _flag(f"regexp_matches(src_ip, '{EXT_LOCAL}')"),
    "dst_local": _flag(f"regexp_matches(dst_ip, '{EXT_LOCAL}')"),
    "has_port_info": _flag("regexp_matches(info, '[0-9]+ →')"),
    "has_error": _flag("regexp_matches(lower(info), 'error|failed|timeout|unreachable')"),
    "is_tcp": _flag("upper(protocol) = 'TCP'"),
    "is_udp": _flag("upper(protocol) = 'UDP'"),
    "is_http": _flag("contains(protocol, 'HTTP')"),
    "is_dns": _flag("upper(protocol) = 'DNS'"),
    "size_small": _flag("length < 100"),
    "size_medium": _flag("length >= 100 and length < 1000"),
    "size_large": _flag("length >= 1000"),
}
BASIC_FLAGS = {
    "src_local": _flag(r"regexp_matches(src_ip, '^(10\.|172\.16\.|192\.168\.)')"),
    "dst_local": _flag(r"regexp_matches(dst_ip, '^(10\.|172\.16\.|192\.168\.)')"),
    "protocol_num": "cast(case protocol when 'TCP' then 1 when 'UDP' then 2 when 'ICMP' then 3 when 'HTTP' then 4"
    " when 'HTTPS' then 5 when 'DNS' then 6 when 'TLS' then 7 when 'TLSv1.2' then 7 when 'TLSv1.3' then 7"
    " else 0 end as int)",
    "has_error": _flag("regexp_matches(lower(info), 'error|reset|refused|failed|timeout')"),
    "is_syn": _flag("contains(info, '[SYN]')"),
    "is_fin": _flag("contains(info, '[FIN')"),
    "is_dns": _flag("regexp_matches(info, 'Standard query|response')"),
}


def _listed(flags: dict[str, str]) -> str:
    return ", ".join(f"{sql} as {name}" for name, sql in flags.items())


def with_packets(captures: bool = False) -> str:
    return f"with recursive packets as ({duckdb_packets(captures)})"


def extended(captures: bool = False) -> str:
    """CTEs up to ``feats``: extended features with their packet columns."""
    keys = "capture_id, " if captures else ""
    over = "partition by capture_id order by" if captures else "order by"
    using = "(capture_id, protocol)" if captures else "(protocol)"
    span = "left join span using (capture_id)" if captures else "cross join span"
    group = "group by capture_id" if captures else ""
    return with_packets(captures) + "," + CLEAN.format(keys=keys) + f""",
ranks as (
  select {keys}protocol, row_number() over ({over} count(*) desc, protocol) - 1 as place
  from clean group by {keys}protocol),
span as (select {keys}min(t) as lo, max(t) as hi from clean {group}),
feats as (
  select {keys}frame_number, row_number() over ({over} frame_number) as packet_number,
    t, src_ip, dst_ip, protocol, info, length,
    cast(case when place < 20 then place else 999 end as int) as protocol_encoded,
    (t - lo) / greatest(hi - lo, 1.0) as time_normalized,
    coalesce(t - lag(t) over ({over} frame_number), 0.0) as time_delta,
    {_listed(EXT_FLAGS)}
  from clean left join ranks using {using} {span})"""


def basic() -> str:
    """CTEs up to ``feats``: basic features with their packet columns."""
    return with_packets() + f""",
feats as (
  select frame_number, row_number() over (order by frame_number) as packet_number,
    src_ip, dst_ip, protocol, info, cast(length as double) as packet_length,
    coalesce(cast(length as double), 0.0) as "Length",
    coalesce("timestamp" - lag("timestamp") over (order by frame_number), 0.0) as time_delta,
    {_listed(BASIC_FLAGS)}
  from packets)"""


def zscores(features: list[str], captures: bool = False) -> str:
    """CTE ``z`` after ``feats``: standardised columns z1..zd."""
    keys = "capture_id, " if captures else ""
    stats = ", ".join(
        f"avg({_number(_q(f))}) as m{i}, case when stddev_pop({_number(_q(f))}) = 0 then 1.0"
        f" else stddev_pop({_number(_q(f))}) end as s{i}"
        for i, f in enumerate(features, 1)
    )
    z = ", ".join(f"({_q(f)} - m{i}) / s{i} as z{i}" for i, f in enumerate(features, 1))
    join = "join stats using (capture_id)" if captures else "cross join stats"
    group = "group by capture_id" if captures else ""
    return f""",
stats as (select {keys}{stats}, count(*) as n from feats {group}),
z as materialized (select {keys}packet_number, n, {z} from feats {join})"""


def _q(name: str) -> str:
    return f'"{name}"'


def lloyd(features: list[str], captures: bool = False, k: int = CLUSTERS, iterations: int = ITERATIONS) -> str:
    """CTEs ``centres``, ``near`` and ``scored`` after ``z``."""
    d = range(1, len(features) + 1)
    keys = "capture_id, " if captures else ""
    zkeys = "z.capture_id, " if captures else ""
    gap = " + ".join(f"(z{i} - c{i}) * (z{i} - c{i})" for i in d)
    start = ", ".join(f"round(z{i}, 9) as c{i}" for i in d)
    step = ", ".join(f"round(avg(z{i}), 9) as c{i}" for i in d)
    held = ", ".join(f"any_value(z{i}) as z{i}" for i in d)
    final = "join (select * from centres where it = {n}) c on z.capture_id = c.capture_id" if captures else \
        "cross join (select * from centres where it = {n}) c"
    stepped = f"join centres c on z.capture_id = c.capture_id and c.it < {iterations}" if captures else \
        f"join centres c on c.it < {iterations}"
    group = "group by capture_id" if captures else ""
    attach = "join span_d using (capture_id)" if captures else "cross join span_d"
    return f""",
centres as (
  select {keys}0 as it, i as cid, {start}
  from z, range({k}) as r(i) where packet_number = cast(floor((i + 0.5) * n / {k}) as bigint) + 1
  union all
  select {keys}it + 1, cid, {step} from (
    select {zkeys}it, packet_number, arg_min(cid, (({gap}), cid)) as cid, {held}
    from z {stepped} group by {zkeys}it, packet_number)
  group by {keys}it, cid),
near as materialized (
  select {zkeys}packet_number, cast(arg_min(cid, (({gap}), cid)) as int) as cluster_id, sqrt(min({gap})) as distance
  from z {final.format(n=iterations)} group by {zkeys}packet_number),
span_d as (
  select {keys}min(distance) as d_lo, max(distance) as d_hi, quantile_cont(distance, 0.9) as cut, count(*) as total
  from near {group}),
scored as materialized (
  select near.*, case when d_hi > d_lo then (distance - d_lo) / (d_hi - d_lo) else distance end as anomaly_score,
    distance > cut as is_anomaly, total,
    case when d_hi > d_lo then (cut - d_lo) / (d_hi - d_lo) else cut end as threshold
  from near {attach})"""


def restarts(features: list[str], captures: bool = False, k: int = CLUSTERS, runs: int = S.DEFAULT_RESTARTS, seed: int = S.DEFAULT_SEED) -> str:
    """CTE ``near`` after ``z``: drawn starts, runs to convergence, the cheapest run of each scope."""
    d = range(1, len(features) + 1)
    keys, zkeys = ("capture_id, ", "z.capture_id, ") if captures else ("", "")
    join = "z.capture_id = s.capture_id" if captures else "true"
    point = "[" + ", ".join(f"z{i}" for i in d) + "]"
    gaps = f"list_transform(s.centres, lambda c: list_distance({point}, c) ** 2)"

    def race(step: int) -> str:
        digits = f"substr(md5('{seed}:' || run || ':{step}:' || packet_number), 1, 13)"
        return f"-ln((('0x' || {digits})::UBIGINT::DOUBLE + 1) / {float(1 << 52)!r})"

    rounded = "[" + ", ".join(f"round(z{i}, 9)" for i in d) + "]"
    drawn = f"""drawn_0 as (
  select {keys}run, [arg_min({rounded}, {race(0)})] as centres from z, range({runs}) as r(run) group by {keys}run)"""
    for step in range(1, k):
        drawn += f""",
drawn_{step} as (
  select {zkeys}run, list_append(any_value(centres), arg_min({rounded}, {race(step)} / gap)) as centres
  from (select z.*, run, centres, list_min({gaps}) as gap from z join drawn_{step - 1} s on {join}) z
  where gap > 1e-12 group by {zkeys}run)"""
    return f""",
{drawn}""" + _converged(features, f"drawn_{k - 1}", captures, k)


def oversampled(features: list[str], k: int = CLUSTERS, runs: int = S.DEFAULT_RESTARTS, seed: int = S.DEFAULT_SEED, rounds: int = 5) -> str:
    """CTE ``near`` after ``z``: rounds of oversampled candidates, weighted draws among them, runs to convergence."""
    d = range(1, len(features) + 1)
    point = "[" + ", ".join(f"z{i}" for i in d) + "]"
    rounded = "[" + ", ".join(f"round(z{i}, 9)" for i in d) + "]"

    def race(label: str, number: str) -> str:
        digits = f"substr(md5('{seed}:' || run || ':{label}:' || {number}), 1, 13)"
        return f"-ln((('0x' || {digits})::UBIGINT::DOUBLE + 1) / {float(1 << 52)!r})"

    gaps = lambda held: f"list_transform({held}, lambda c: list_distance({point}, c) ** 2)"
    sql = f""",
set_0 as (
  select run, [arg_min({rounded}, {race('0', 'packet_number')})] as held, [0::BIGINT] as numbers, count(*)::DOUBLE * {len(d)} as potential
  from z, range({runs}) as r(run) group by run)"""
    for step in range(rounds):
        sql += f""",
set_{step + 1} as (
  select run, list_concat(any_value(held), coalesce(list(point order by key, packet_number) filter (key < {2 * k} / potential), [])) as held,
    list_concat(any_value(numbers), coalesce(list(packet_number::BIGINT order by key, packet_number) filter (key < {2 * k} / potential), [])) as numbers, sum(gap) as potential
  from (select *, case when gap > 1e-12 then {race(f'r{step}', 'packet_number')} / gap end as key
    from (select packet_number, {rounded} as point, run, held, numbers, potential, list_min({gaps('held')}) as gap from z, set_{step}))
  group by run)"""
    sql += f""",
weights as (
  select run, spot, count(*) as weight from (
    select run, list_position(gs, list_min(gs)) as spot from (select run, {gaps('held')} as gs from z, set_{rounds})) group by run, spot),
listed as (select run, unnest(held) as point, unnest(numbers) as number, unnest(range(1, len(held) + 1)) as spot from set_{rounds}),
weighed as (select * from listed join weights using (run, spot)),
picked_0 as (select run, [arg_min(point, ({race('w0', 'number')} / weight, number))] as centres from weighed group by run)"""
    for step in range(1, k):
        sql += f""",
picked_{step} as (
  select run, list_append(any_value(centres), arg_min(point, ({race(f'w{step}', 'number')} / (weight * gap), number))) as centres
  from (select *, list_min(list_transform(centres, lambda c: list_distance(point, c) ** 2)) as gap from weighed join picked_{step - 1} using (run))
  where gap > 1e-12 group by run)"""
    return sql + _converged(features, f"picked_{k - 1}", False, k)


def _refit(k: int = CLUSTERS, decay: float = 0.9) -> str:
    """Centres of a full fit on the first half of the packets, and after one weighted step by the second half."""
    d = range(1, len(EXT) + 1)
    half = f"(select count(*) // 2 from events)"
    first = extended().replace(duckdb_packets(), f"select * from ({duckdb_packets()}) where frame_number <= {half}", 1)
    row = lambda name: "[" + ", ".join(f"{name}{i}" for i in d) + "]"
    moments = lambda source: f"select count(*) as n, " + ", ".join(
        f"avg({_number(_q(f))}) as m{i}, var_pop({_number(_q(f))}) * count(*) as v{i}" for i, f in enumerate(EXT, 1)) + f" from {source}"
    merged = ", ".join(
        f"(a.n * a.m{i} + b.n * b.m{i}) / (a.n + b.n) as m{i}, a.v{i} + b.v{i} + (b.m{i} - a.m{i}) ** 2 * (a.n::DOUBLE * b.n / (a.n + b.n)) as v{i}" for i in d)
    scale = lambda v, n: f"case when {v} = 0 then 1.0 else sqrt({v} / {n}) end"
    point = "[" + ", ".join(f"({_q(f)} - m{i}) / s{i}" for i, f in enumerate(EXT, 1)) + "]"
    names = "[" + ", ".join(f"'{n}'" for n in EXT) + "]"
    out = lambda batch, so_far, kind, read, source: (
        f"select {batch}::BIGINT as batch_id, ({so_far})::BIGINT as packets_so_far, '{kind}' as kind, ({read})::BIGINT as packets_read, cluster_id::INTEGER as cluster_id,"
        f" unnest({names}) as feature, unnest(list_transform(centre, lambda x: round(x, 6))) as centre from {source}")
    return f"""
with recursive begun as ({first}{zscores(EXT)}{restarts(EXT, k=k)}, own as ({moments("feats")})
  select cid - 1 as cluster_id, centre, (select count(*) from near where cluster_id = cid - 1) as weight, own.* from
    (select unnest(centres) as centre, unnest(range(1, {k + 1})) as cid from chosen), own),
later as ({extended()} select * from feats where frame_number > {half}),
own as ({moments("later")}),
both_ as (select a.n + b.n as n, {merged} from (select distinct n, {", ".join(f"m{i}, v{i}" for i in d)} from begun) a, own b),
scaled as (select *, {", ".join(f"{scale(f'v{i}', 'n')} as s{i}" for i in d)} from both_),
moved as (select cluster_id, weight, [{", ".join(f"(b.centre[{i}] * {scale(f'b.v{i}', 'b.n')} + b.m{i} - s.m{i}) / s.s{i}" for i in d)}] as c from begun b, scaled s),
held as (select list(c order by cluster_id) as cs from moved),
placed as (select z, list_position(gaps, list_min(gaps)) - 1 as cluster_id from (
  select z, list_transform(cs, lambda c: list_distance(z, c) ** 2) as gaps from (select {point} as z from later, scaled), held)),
sums as (select cluster_id, count(*) as n, [{", ".join(f"sum(z[{i}])" for i in d)}] as total from placed group by cluster_id),
stepped as (select cluster_id, case when n is null then c else list_transform(range(1, {len(d) + 1}),
    lambda i: ({decay} * weight * c[i] + total[i]) / ({decay} * weight + n)) end as centre from moved left join sums using (cluster_id))
{out(0, f"select {half}", "full", f"select {half}", "begun")}
union all {out(1, "select count(*) from events", "step", f"select count(*) - {half} from events", "stepped")}"""


def _rare(share: float = S.RARE_PROTOCOL_SHARE) -> str:
    """Minimal rare sets of protocol, direction, port text and size class, per packet."""
    names = ("protocol", "direction", "port", "size")
    chosen = [[n for i, n in enumerate(names) if mask >> i & 1] for mask in range(1, 16)]
    flag = lambda n: f"case when grouping({n}) = 0 then '{n}=' || {n} end"
    inside = " and ".join(f"(a.{n} is null or a.{n} = b.{n})" for n in names)
    own = " and ".join(f"(s.{n} is null or s.{n} = k.{n})" for n in names)
    size = lambda t: " + ".join(f"({t}.{n} is not null)::INT" for n in names)
    return extended() + f""",
kinds as (select frame_number, protocol, case when src_local = 1 and dst_local = 1 then 'inside' when src_local = 1 then 'outward'
    when dst_local = 1 then 'inward' else 'outside' end as direction, case when has_port_info = 1 then 'yes' else 'no' end as port,
    case when size_small = 1 then 'small' when size_medium = 1 then 'medium' else 'large' end as size from feats),
sets as (select {", ".join(names)}, concat_ws(', ', {", ".join(flag(n) for n in names)}) as reason,
    count(*) < {share} * (select count(*) from kinds) as rare from kinds group by grouping sets ({", ".join("(" + ", ".join(c) + ")" for c in chosen)})),
minimal as (select * from sets b where rare and not exists (select 1 from sets a where a.rare and {inside} and {size("a")} < {size("b")}))
select k.frame_number, s.reason from kinds k join minimal s on {own}"""


def _converged(features: list[str], start: str, captures: bool, k: int) -> str:
    """CTEs ``chosen`` and ``near``: steps from the centres of ``start``, then the cheapest run."""
    d = range(1, len(features) + 1)
    keys, zkeys = ("capture_id, ", "z.capture_id, ") if captures else ("", "")
    join = "z.capture_id = s.capture_id" if captures else "true"
    point = "[" + ", ".join(f"z{i}" for i in d) + "]"
    gaps = f"list_transform(s.centres, lambda c: list_distance({point}, c) ** 2)"
    mean = "[" + ", ".join(
        "[" + ", ".join(f"coalesce(round(avg(z{i}) filter (cid = {c}), 9), any_value(centres[{c}][{i}]))" for i in d) + "]"
        for c in range(1, k + 1)) + "]"
    moved = " + ".join(f"list_distance(centres[{c}], stepped[{c}]) ** 2" for c in range(1, k + 1))
    return f""",
steps as (
  select {keys}run, 0 as it, centres, true as moving from {start}
  union all
  select {keys}run, it + 1, stepped, {moved} > 1e-4 from (
    select {zkeys}run, it, any_value(centres) as centres, {mean} as stepped from (
      select z.*, run, it, centres, list_position(gaps, list_min(gaps)) as cid from (
        select z.*, run, it, centres, {gaps} as gaps from z join steps s on {join} and s.moving and s.it < 300) z) z
    group by {zkeys}run, it)),
costs as (
  select {zkeys}run, any_value(centres) as centres, round(sum(list_min({gaps})), 6) as cost
  from z join (select * from steps where not moving or it = 300) s on {join} group by {zkeys}run),
chosen as (select {keys}arg_min(centres, (cost, run)) as centres from costs {"group by capture_id" if captures else ""}),
near as materialized (
  select {zkeys}packet_number, cast(list_position(gaps, list_min(gaps)) - 1 as int) as cluster_id, sqrt(list_min(gaps)) as distance
  from (select z.*, {gaps} as gaps from z join chosen s on {join}) z)"""


def components(features: list[str], captures: bool = False, steps: int = 3000) -> str:
    """CTE ``axes`` after ``z``: two principal components by power iteration and deflation."""
    d = range(1, len(features) + 1)
    keys = "capture_id, " if captures else ""
    group = "group by capture_id" if captures else ""
    matrix = ", ".join("[" + ", ".join(f"covar_pop(z{i}, z{j})" for j in d) + "]" for i in d)
    start = "[" + ", ".join(f"{1 + 0.37 * i % 1:.2f}::DOUBLE" for i in d) + "]"
    times = "list_transform({c}, lambda r: list_dot_product(r, {v}))"

    def power(name: str, matrices: str) -> str:
        return f"""{name}_s as (
  select {keys}c, trace, {start} as v, 0 as it from {matrices}
  union all
  select {keys}c, trace, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))), it + 1
  from (select *, {times.format(c='c', v='v')} as w from {name}_s where it < {steps})),
{name} as (
  select {keys}c, trace, list_transform(v, lambda x: x * sign(v[list_position(list_transform(v, lambda y: abs(y)), list_max(list_transform(v, lambda y: abs(y))))])) as v,
    list_dot_product(v, {times.format(c='c', v='v')}) as size from {name}_s where it = {steps})"""

    trace = " + ".join(f"c[{i}][{i}]" for i in d)
    return f""",
covs as (select {keys}c, {trace} as trace from (select {keys}[{matrix}] as c from z {group})),
{power("axis_1", "covs")},
rest as (select {keys}list_transform(range(1, {len(d) + 1}), lambda i: list_transform(range(1, {len(d) + 1}), lambda j: c[i][j] - size * v[i] * v[j])) as c, trace from axis_1),
{power("axis_2", "rest")},
axes as (select {keys}1 as component, v, size / trace as ratio from axis_1 union all select {keys}2, v, size / trace from axis_2)"""


def loadings(features: list[str], captures: bool = False) -> str:
    keys = "capture_id, " if captures else ""
    names = "[" + ", ".join(f"'{n}'" for n in features) + "]"
    return f""" select {keys}cast(component as int) as component, cast(place as int) as rank, feature, round(weight, 6) as weight, round(ratio, 6) as ratio
  from (select *, row_number() over (partition by {keys}component order by abs(weight) desc, spot) as place
    from (select {keys}component, ratio, unnest(range(1, {len(features) + 1})) as spot, unnest({names}) as feature, unnest(v) as weight from axes)) where place <= 5"""


def projected(features: list[str], source: str, columns: str, captures: bool = False, letter: str = "z") -> str:
    d = range(1, len(features) + 1)
    point = "[" + ", ".join(f"{letter}{i}" for i in d) + "]"
    both = " and a.capture_id = s.capture_id and b.capture_id = s.capture_id" if captures else ""
    return f""" select {columns}, round(list_dot_product({point}, a.v), 6) as pc1, round(list_dot_product({point}, b.v), 6) as pc2
  from {source} s join axes a on a.component = 1 join axes b on b.component = 2{both}"""


EXT, BAS = S.EXTENDED_FEATURES, S.BASIC_FEATURES


def _rounded(names: list[str]) -> str:
    return ", ".join(f"round({_q(n)}, 6) as {_q(n)}" if n in ("time_normalized", "time_delta") else _q(n) for n in names)


def _ext_analysis() -> str:
    return extended() + zscores(EXT) + lloyd(EXT)


def _bas_analysis(k: int = CLUSTERS) -> str:
    return basic() + zscores(BAS) + lloyd(BAS, k=k)


SIZES = """,
sizes as (
  select cluster_id, count(*) as packets, any_value(total) as total,
    count(*) * 100.0 / any_value(total) as percent, count(*) < any_value(total) * 0.05 as is_small
  from scored group by cluster_id),
lab as materialized (select feats.*, cluster_id, anomaly_score, is_anomaly, total from feats join scored using (packet_number))"""

LINE = """concat(coalesce(protocol, 'nan'), ' ', coalesce(src_ip, 'nan'), ' -> ', coalesce(dst_ip, 'nan'),
  ' (', {length}, ' bytes): ', substring(coalesce(info, ''), 1, {width}), '...')"""


def statements() -> dict[str, str]:
    pk, ext, bas = with_packets(), extended(), basic()
    ea, ba = _ext_analysis(), _bas_analysis()
    small = _bas_analysis(k=8) + SIZES
    bs, es = ba + SIZES, ea + SIZES
    canonical = """select frame_number, round("timestamp", 6) as "timestamp", coalesce(src_ip, 'unknown') as src_ip,
      coalesce(dst_ip, 'unknown') as dst_ip, coalesce(protocol, 'unknown') as protocol,
      cast(coalesce(length, 0) as double) as length, coalesce(info, '') as info from packets"""
    raw = """select frame_number, round("timestamp", 6) as "timestamp", src_ip, dst_ip, protocol,
      cast(length as double) as length, info from packets"""
    line50 = LINE.format(length="cast(cast(packet_length as bigint) as varchar)", width=50)
    out = {
        # sources
        "scan_quoted_csv": f"{pk} {canonical}",
        "scan_basic_csv": f"{pk} {raw}",
        "scan_ragged_csv": f"""{pk} select frame_number, coalesce(src_ip, '') as src_ip, coalesce(dst_ip, '') as dst_ip,
          case when frame_number % 2 = 0 then coalesce(protocol, '') else '' end as protocol,
          case when frame_number % 2 = 0 then cast(length as double) else 0.0 end as length,
          case when frame_number % 2 = 0 then coalesce(info, '') else '' end as info from packets""",
        "scan_multiline_csv": f"""{pk} select frame_number, coalesce(src_ip, 'unknown') as src_ip, coalesce(protocol, 'unknown') as protocol,
          cast(length as double) as length, translate(info, '→', '>') || case frame_number % 3
            when 0 then chr(10) || 'second line, of "' || frame_number || '"' || chr(13) || chr(10) || chr(10)
            when 1 then ' "quoted"' else ' back\\slash' end as info from packets""",
        "refused_lists": f"""{pk} select 'part' || frame_number % 4 as capture_id, case when frame_number % 4 <> 2 then count(*) end as packets,
            case when frame_number % 4 = 2 then 'header' else 'read' end as reason from packets group by frame_number % 4
          union all select 'part3', null, 'a quote that never ends'""",
        "encoding_fallback": f"""{pk} select frame_number, src_ip, dst_ip, protocol,
          cast(length as double) as length, concat('café ', info) as info from packets""",
        "schema_check": f"""{pk}, n as (select count(*) as packets from packets)
          select 'full' as layout, cast(0 as int) as missing_columns, 'ok' as status, packets from n union all
          select 'no_protocol', 1, 'warn', packets from n union all
          select 'text_only', 4, 'reject', packets from n""",
        "rename_fill_defaults": f"{pk} {canonical}",
        "synthesize_sequence": f"""{pk} select row_number() over (order by frame_number) as frame_number,
          cast(row_number() over (order by frame_number) - 1 as double) as "timestamp",
          coalesce(src_ip, 'unknown') as src_ip, coalesce(info, '') as info from packets""",
        "first_occurrence": f"""{pk} select cast(frame_number as varchar) as "No.", src_ip as "Source",
          dst_ip as "Destination", protocol as "Protocol", info as "Info" from packets""",
        "capture_catalog": f"""with packets as ({duckdb_packets(True)})
          select distinct capture_id, 'cap' as suffix, 2 as depth, true as below_limit from packets""",
        "capture_records": f"""with packets as ({duckdb_packets(True)})
          select capture_id, count(*) as packets, count(*) as last_number, sum(length)::BIGINT as bytes,
            round(min("timestamp"), 6) as first_time, round(max("timestamp"), 6) as last_time, 0::BIGINT as broken from packets group by capture_id""",
        "capture_order": f"""with packets as ({duckdb_packets(True)})
          select distinct capture_id, case capture_id when 'cap2' then 0 when 'cap0' then 1 else 2 end::BIGINT as newer from packets""",
        "latest_capture": "select 'pcapng' as suffix, 1 as depth, count(*) > 0 as is_count from events",
        "capture_facts": f"""with packets as ({duckdb_packets(True)})
          select capture_id, count(*) as packets, true as has_content from packets group by capture_id""",
        "time_delta_many_captures": f"""with packets as ({duckdb_packets(True)}),
          again as (select capture_id, (frame_number - 1) // 3 + 1 as frame_number, "timestamp" as t from packets)
          select capture_id, frame_number, row_number() over (order by capture_id, frame_number, t) as packet_number,
            round(coalesce(t - lag(t) over (partition by capture_id order by frame_number, t), 0.0), 6) as time_delta from again""",
        "fit_with_short_captures": f"""with packets as ({duckdb_packets(True)}),
          named as (select case when frame_number <= 4 then concat('short', cast(frame_number % 3 as varchar))
            else capture_id end as capture_id from packets)
          select capture_id, count(*) as packets, count(*) >= {CLUSTERS} as fitted from named group by capture_id""",
        "stream_new_capture": f"""with packets as ({duckdb_packets(True)})
          select capture_id, case when capture_id = 'cap0' then 'own' else 'pooled' end as model,
            count(*) as scored, count(*) as flagged, count(*) as labelled from packets group by capture_id""",
        "score_cutoff_by_capture": extended(True) + zscores(EXT, True) + lloyd(EXT, True)
        + """ select capture_id, packet_number, cluster_id, round(anomaly_score, 6) as anomaly_score
          from scored where anomaly_score > 0.8""",
        "anomaly_reasons_by_capture": f"""with packets as ({duckdb_packets(True)}),
          feats as (select capture_id, row_number() over (partition by capture_id order by frame_number) as packet_number,
            case when capture_id <> 'cap0' then concat('E', cast(frame_number as varchar)) else coalesce(protocol, 'unknown') end as protocol,
            {EXT_FLAGS["has_error"]} as has_error
            from packets),
          total as (select capture_id, count(*) as n from feats group by capture_id),
          shares as (select capture_id, protocol, count(*) as m from feats group by 1, 2)
          select capture_id, packet_number, m < n * 0.01 as rare_protocol, has_error = 1 as error_flag
          from feats join total using (capture_id) join shares using (capture_id, protocol) where m < n * 0.01 or has_error = 1""",
        "multi_capture_counts": f"""with packets as ({duckdb_packets(True)})
          select capture_id, count(*) as packets, cast(count(distinct frame_number) as bigint) as frames
          from packets group by capture_id""",
        "json_results": f"""{ea} select packet_number, cluster_id,
          round(anomaly_score, 6) as anomaly_score, is_anomaly from scored""",
        "csv_results": f"""{ea} select packet_number, cluster_id,
          round(anomaly_score, 6) as anomaly_score, is_anomaly from scored""",
        # features
        "length_numeric": f"{ext} select frame_number, length from feats",
        "protocol_rank": f"{ext} select frame_number, protocol, protocol_encoded from feats",
        "time_normalized": f"{ext} select frame_number, round(time_normalized, 6) as time_normalized from feats",
        "ip_locality_ext": f"{ext} select frame_number, src_local, dst_local from feats",
        "port_info": f"{ext} select frame_number, has_port_info from feats",
        "error_flag_ext": f"{ext} select frame_number, has_error from feats",
        "protocol_flags": f"{ext} select frame_number, is_tcp, is_udp, is_http, is_dns from feats",
        "size_class": f"{ext} select frame_number, size_small, size_medium, size_large from feats",
        "features_ext": f"{ext} select frame_number, packet_number, {_rounded(EXT)} from feats",
        "features_ext_by_capture": f"""{extended(True)} select capture_id, frame_number, packet_number, {_rounded(EXT)}
          from feats""",
        "ip_locality_basic": f"{bas} select frame_number, src_local, dst_local from feats",
        "protocol_num": f"{bas} select frame_number, protocol_num from feats",
        "numeric_coerce": f"""{pk} select frame_number, case when frame_number % 3 = 0 then null
          else cast(length as double) end as length, case when frame_number % 5 = 0 then null
          else cast(frame_number * 1000 as double) end as scaled from packets""",
        "info_flags_basic": f"{bas} select frame_number, has_error, is_syn, is_fin, is_dns from feats",
        "features_basic": f"{bas} select frame_number, packet_number, {_rounded(BAS)} from feats",
        "packet_line": f"{pk} select frame_number, {LINE.format(length='cast(length as varchar)', width=50)} as line from packets",
        "score_band": f"""{ea} select packet_number, case when anomaly_score < 0.3 then 'low'
          when anomaly_score < 0.7 then 'medium' else 'high' end as score_band from scored""",
        "time_delta_ext": f"{ext} select frame_number, round(time_delta, 6) as time_delta from feats",
        "time_delta_basic": f"{bas} select frame_number, round(time_delta, 6) as time_delta from feats",
        # traffic
        "protocol_counts": f"""{ext} select protocol, count(*) as packets from feats group by protocol
          order by packets desc, protocol limit 20""",
        "protocol_distribution": f"""{pk} select protocol, count(*) as packets,
          round(count(*) * 100.0 / (select count(*) from packets), 6) as percent
          from packets where protocol is not null group by protocol""",
        "length_stats": f"""{pk} select round(avg(length), 6) as avg_length, cast(min(length) as double) as min_length,
          cast(max(length) as double) as max_length from packets""",
        "capture_rate": f"""{pk} select count(*) as packets, round(max("timestamp") - min("timestamp"), 6) as duration,
          round(count(*) / (max("timestamp") - min("timestamp")), 6) as packet_rate from packets""",
        "top_sources": f"""{pk} select src_ip, count(*) as packets,
          round(count(*) * 100.0 / (select count(*) from packets), 6) as percent from packets
          where src_ip is not null group by src_ip order by packets desc, src_ip limit 5""",
        "top_sources_exact_summary": f"""{pk} select src_ip, count(*) as packets,
          round(count(*) * 100.0 / (select count(*) from packets), 6) as percent from packets
          where src_ip is not null group by src_ip order by packets desc, src_ip limit 5""",
        "top_destinations": f"""{pk} select dst_ip, count(*) as packets,
          round(count(*) * 100.0 / (select count(*) from packets), 6) as percent from packets
          where dst_ip is not null group by dst_ip order by packets desc, dst_ip limit 5""",
        "traffic_summary": f"""{pk}, n as (select count(*) as total from packets),
          counted as (
            select 'protocol' as section, protocol as item, count(*) as packets from packets group by protocol
            union all select 'src_ip', src_ip, count(*) from packets group by src_ip
            union all select 'dst_ip', dst_ip, count(*) from packets group by dst_ip),
          placed as (select *, row_number() over (partition by section order by packets desc, item) as place
            from counted where item is not null),
          facts as (select count(*) as packets, avg(length) as avg_length, cast(min(length) as double) as min_length,
            cast(max(length) as double) as max_length, max("timestamp") - min("timestamp") as duration from packets)
          select section, item, packets, round(packets * 100.0 / total, 6) as value from placed cross join n
            where section = 'protocol' or place <= 5
          union all select 'totals', 'avg_length', packets, round(avg_length, 6) from facts
          union all select 'totals', 'min_length', packets, min_length from facts
          union all select 'totals', 'max_length', packets, max_length from facts
          union all select 'totals', 'duration', packets, round(duration, 6) from facts
          union all select 'totals', 'packet_rate', packets, round(packets / duration, 6) from facts""",
        # model
        "zscore": ext + zscores(EXT) + " select packet_number, "
        + ", ".join(f"round(z{i}, 6) as z{i}" for i in range(1, len(EXT) + 1)) + " from z",
        "kmeans_lloyd": f"""{ea} select packet_number, cluster_id, round(distance, 6) as distance from near""",
        "kmeans_lloyd_by_capture": extended(True) + zscores(EXT, True) + lloyd(EXT, True)
        + " select capture_id, packet_number, cluster_id, round(distance, 6) as distance from near",
        "kmeans_oversampled": extended() + zscores(EXT) + oversampled(EXT) + """
          select packet_number, cluster_id, round(distance, 6) as distance from near""",
        "kmeans_k20": extended() + zscores(EXT) + restarts(EXT, k=20, runs=2) + """
          select packet_number, cluster_id, round(distance, 6) as distance from near""",
        "centroid_distance_k20": extended() + zscores(EXT) + restarts(EXT, k=20, runs=2) + f""" select packet_number, cast(cid - 1 as int) as cluster_id,
          round(list_distance([{", ".join(f"z{i}" for i in range(1, len(EXT) + 1))}], centre), 6) as distance
          from z, (select unnest(centres) as centre, unnest(range(1, 21)) as cid from chosen)""",
        "kmeans_restarts": ext + zscores(EXT) + restarts(EXT)
        + " select packet_number, cluster_id, round(distance, 6) as distance from near",
        "kmeans_restarts_by_capture": extended(True) + zscores(EXT, True) + restarts(EXT, True)
        + " select capture_id, packet_number, cluster_id, round(distance, 6) as distance from near",
        "kmeans_centres": f"""{ea} select cast(cid as int) as cluster_id, """
        + ", ".join(f"round(c{i}, 6) as {_q(n)}" for i, n in enumerate(EXT, 1)) + f" from centres where it = {ITERATIONS}",
        "centroid_distance": f"""{ea}, c as (select * from centres where it = {ITERATIONS})
          select packet_number, """
        + ", ".join(
            f"round(max(case when cid = {j} then sqrt("
            + " + ".join(f"(z{i} - c{i}) * (z{i} - c{i})" for i in range(1, len(EXT) + 1))
            + f") end), 6) as distance_{j}"
            for j in range(CLUSTERS)
        )
        + " from z cross join c group by packet_number",
        "score_minmax": f"{ea} select packet_number, round(anomaly_score, 6) as anomaly_score from scored",
        "score_stats": f"""{ea} select round(avg(anomaly_score), 6) as mean_score,
          round(stddev_pop(anomaly_score), 6) as std_score, round(any_value(threshold), 6) as high_anomaly_threshold,
          count(*) filter (where is_anomaly) as high_anomaly_count from scored""",
        "high_anomalies": f"""{ea} select packet_number, cluster_id, round(anomaly_score, 6) as anomaly_score
          from scored where is_anomaly""",
        "flagged_packets": f"""{ea} select frame_number, cluster_id, round(anomaly_score, 6) as anomaly_score, is_anomaly
          from scored join feats using (packet_number)""",
        "analysis_summary": f"""{es} select 'total_packets' as item, cast(any_value(total) as double) as value from scored
          union all select 'num_clusters', {CLUSTERS}.0
          union all select concat('cluster_', cast(cluster_id as varchar)), cast(packets as double) from sizes
          union all select concat('small/cluster_', cast(cluster_id as varchar)), cast(packets as double) from sizes where is_small
          union all select 'mean_score', round(avg(anomaly_score), 6) from scored
          union all select 'std_score', round(stddev_pop(anomaly_score), 6) from scored
          union all select 'high_anomaly_threshold', round(any_value(threshold), 6) from scored
          union all select 'high_anomaly_count', cast(count(*) filter (where is_anomaly) as double) from scored""",
        "summary_by_capture": extended(True) + zscores(EXT, True) + lloyd(EXT, True)
        + """ select capture_id, any_value(total) as packets, round(avg(anomaly_score), 6) as mean_score,
          round(stddev_pop(anomaly_score), 6) as std_score, round(any_value(threshold), 6) as threshold,
          count(*) filter (where is_anomaly) as above from scored group by capture_id""",
        "pca_loadings": ext + zscores(EXT) + components(EXT) + loadings(EXT),
        "pca_loadings_by_capture": extended(True) + zscores(EXT, True) + components(EXT, True) + loadings(EXT, True),
        "pca_projection": ea + components(EXT)
        + projected(EXT, "(select z.*, cluster_id from z join near using (packet_number))", "packet_number, cluster_id"),
        "pca_projection_budget": ea + components(EXT)
        + projected(EXT, "(select z.*, cluster_id from z join near using (packet_number))", "packet_number, cluster_id")
        + " order by ('0x' || substr(md5(packet_number || ':42'), 1, 13))::bigint, packet_number limit 500",
        "pca_projection_by_capture": extended(True) + zscores(EXT, True) + lloyd(EXT, True) + components(EXT, True)
        + projected(EXT, "(select z.*, cluster_id from z join near using (capture_id, packet_number))", "s.capture_id, packet_number, cluster_id", True),
        "pca_centroids": ea + components(EXT)
        + projected(EXT, f"(select * from centres where it = {ITERATIONS})", "cast(cid as int) as cluster_id", letter="c"),
        # clusters
        "cluster_sizes": f"{bs} select cluster_id, packets, round(percent, 6) as percent, is_small from sizes",
        "small_clusters": f"{small} select cluster_id, packets, round(percent, 6) as percent from sizes where is_small",
        "cluster_length": f"""{bs} select cluster_id, round(avg(packet_length), 6) as avg_length,
          max(packet_length) as max_length from lab group by cluster_id""",
        "cluster_protocols": f"""{bs} select cluster_id, protocol, count(*) as packets,
          cast(sum(has_error) as bigint) as error_packets from lab where protocol is not null group by 1, 2""",
        "cluster_top3": f"""{bs}, counted as (
            select cluster_id, 'protocol' as kind, protocol as item, count(*) as packets from lab group by 1, 3
            union all select cluster_id, 'src_ip', src_ip, count(*) from lab group by 1, 3
            union all select cluster_id, 'dst_ip', dst_ip, count(*) from lab group by 1, 3),
          placed as (select *, row_number() over (partition by cluster_id, kind order by packets desc, item) as place
            from counted where item is not null)
          select p.cluster_id, kind, cast(place as int) as rank, item, p.packets,
            round(p.packets * 100.0 / s.packets, 6) as percent
          from placed p join sizes s using (cluster_id) where place <= 3""",
        "small_cluster_samples": f"""{small}, few as (select lab.* from lab join sizes using (cluster_id) where is_small)
          select cluster_id, cast(place as int) as rank, packet_number, {line50} as line
          from (select *, row_number() over (partition by cluster_id order by packet_number) as place from few)
          where place <= 3""",
        "cluster_samples": f"""{bs} select cluster_id, cast(place as int) as rank, packet_number, {line50} as line
          from (select *, row_number() over (partition by cluster_id order by packet_number) as place from lab)
          where place <= 2""",
        "cluster_members": f"{bs} select packet_number, cluster_id from lab where cluster_id = 1",
        "cluster_profile": f"""{bs}, shape as (
            select cluster_id, avg(packet_length) as avg_length, max(packet_length) as max_length,
              arg_min({line50}, packet_number) as first_line from lab group by cluster_id),
          counted as (
            select cluster_id, 'protocol' as kind, protocol as item, count(*) as n from lab group by 1, 3
            union all select cluster_id, 'src_ip', src_ip, count(*) from lab group by 1, 3
            union all select cluster_id, 'dst_ip', dst_ip, count(*) from lab group by 1, 3),
          leading_items as (
            select cluster_id, max(case when kind = 'protocol' then item end) as top_protocol,
              max(case when kind = 'src_ip' then item end) as top_source,
              max(case when kind = 'dst_ip' then item end) as top_destination
            from (select *, row_number() over (partition by cluster_id, kind order by n desc, item) as place
              from counted where item is not null) where place = 1 group by cluster_id)
          select cluster_id, packets, round(percent, 6) as percent, round(avg_length, 6) as avg_length, max_length,
            is_small, top_protocol, top_source, top_destination, first_line
          from sizes join shape using (cluster_id) join leading_items using (cluster_id)""",
        "small_cluster_packets": f"""{small} select packet_number, cluster_id from lab
          where cluster_id in (select cluster_id from sizes where is_small)""",
        # anomalies
        "long_packets": f"""{pk}, q as (select quantile_cont(cast(length as double), 0.995) as length_threshold from packets)
          select frame_number, cast(length as double) as length, round(length_threshold, 6) as length_threshold
          from packets cross join q where length > length_threshold""",
        "long_packet_lines": f"""{bas}, q as (select quantile_cont(packet_length, 0.995) as cut from feats)
          select cast(row_number() over (order by packet_number) as int) as rank, packet_number, {line50} as line
          from feats cross join q where packet_length > cut order by packet_number limit 3""",
        "error_packets": f"{bas} select packet_number, protocol, info from feats where has_error = 1",
        "error_packet_lines": f"""{bas} select cast(row_number() over (order by packet_number) as int) as rank, packet_number,
          concat(coalesce(protocol, 'nan'), ' ', coalesce(src_ip, 'nan'), ' -> ', coalesce(dst_ip, 'nan'), ': ',
            substring(coalesce(info, ''), 1, 100), '...') as line
          from feats where has_error = 1 order by packet_number limit 3""",
        "anomaly_reasons": f"""{es}, shares as (select protocol, count(*) as n from feats group by protocol)
          select packet_number, cluster_id, round(anomaly_score, 6) as anomaly_score, is_anomaly as high_score,
            is_small as small_cluster, n < lab.total * 0.01 as rare_protocol, has_error = 1 as error_flag,
            array_to_string(list_filter([case when is_anomaly then 'high_score' end,
              case when is_small then 'small_cluster' end,
              case when n < lab.total * 0.01 then 'rare_protocol' end,
              case when has_error = 1 then 'error_flag' end], lambda x: x is not null), ',') as reasons
          from lab join sizes using (cluster_id) join shares using (protocol)
          where is_anomaly or is_small or n < lab.total * 0.01 or has_error = 1""",
        "score_cutoff": f"""{ea} select packet_number, cluster_id,
          round(anomaly_score, 6) as anomaly_score from scored where anomaly_score > 0.8""",
        "anomaly_report": f"""{small}, sm as (select lab.* from lab join sizes using (cluster_id) where is_small),
          q as (select quantile_cont(packet_length, 0.995) as cut from feats)
          select 'small_cluster' as section, cast(cluster_id as varchar) as item, count(*) as packets,
            round(avg(packet_length), 6) as avg_length, max(packet_length) as max_length,
            cast(sum(has_error) as bigint) as error_packets from sm group by cluster_id
          union all select 'small_cluster_protocol', concat(cast(cluster_id as varchar), '/', protocol), count(*),
            null, null, null from sm where protocol is not null group by cluster_id, protocol
          union all select 'long_packets', 'all', count(*), round(avg(packet_length), 6), max(packet_length),
            cast(sum(has_error) as bigint) from feats cross join q where packet_length > cut
          union all select 'error_packets', 'all', count(*), round(avg(packet_length), 6), max(packet_length),
            cast(sum(has_error) as bigint) from feats where has_error = 1""",
        # series
        "feature_importance": f"""{es}, means as (select cluster_id, """
        + ", ".join(f"avg({_number(_q(n))}) as {_q(n)}" for n in EXT) + """ from lab group by cluster_id)
          select feature, round(importance, 6) as importance from ("""
        + " union all ".join(f"select '{n}' as feature, var_samp({_q(n)}) as importance from means" for n in EXT) + ")",
        "score_histogram": f"""{ea}, counted as (
            select least(cast(floor(anomaly_score * 30 / 1.0) as int), 29) as bin, count(*) as packets from scored group by 1)
          select cast(i as int) as bin, round(i / 30.0, 6) as bin_start, round((i + 1) / 30.0, 6) as bin_end,
            coalesce(packets, 0) as packets, round((select any_value(threshold) from scored), 6) as threshold
          from range(30) r(i) left join counted on bin = i""",
        "score_timeline": f"""{ea} select packet_number, round(anomaly_score, 6) as anomaly_score,
          round(threshold, 6) as threshold, is_anomaly from scored""",
        "length_vs_score": f"""{ea} select packet_number, length, round(anomaly_score, 6) as anomaly_score, cluster_id
          from scored join feats using (packet_number)""",
        "feature_covariance": ext + zscores(EXT) + " " + " union all ".join(
            f"select '{a}' as feature_a, '{b}' as feature_b, round(avg(z{i} * z{j}) - avg(z{i}) * avg(z{j}), 6) as covariance from z"
            for i, a in enumerate(EXT, 1) for j, b in enumerate(EXT, 1) if i <= j
        ),
        "sample_exact": f"""{pk} select frame_number, protocol from packets
          order by ('0x' || substr(md5(concat(cast(frame_number as varchar), ':42')), 1, 13))::bigint, frame_number
          limit 1000""",
        # streaming
        "stream_score": f"""{ea} select packet_number, cluster_id, round(anomaly_score, 6) as anomaly_score, is_anomaly
          from scored""",
        "stream_score_csv": f"""{ea} select packet_number, cluster_id, round(anomaly_score, 6) as anomaly_score, is_anomaly,
          1::BIGINT as latin1, 1::BIGINT as ragged from scored""",
        "stream_delta": f"""with packets as ({duckdb_packets(True)})
          select capture_id, frame_number, round(coalesce("timestamp" - lag("timestamp") over
            (partition by capture_id order by frame_number), 0.0), 6) as time_delta from packets""",
        "stream_refit": _refit(),
        "rare_combinations": _rare(),
        "stream_counts": f"""with packets as ({duckdb_packets(True)})
          select capture_id, protocol, count(*) as packets from packets where protocol is not null group by 1, 2""",
        # extension and guards
        "custom_feature": f"""{ext}, x as (select packet_number, cast(length(info) as double) as info_chars from feats)
          select packet_number, info_chars, round((info_chars - (select avg(info_chars) from x)) /
            (select stddev_pop(info_chars) from x), 6) as z_info_chars from x""",
        "guards": f"""with packets as ({duckdb_packets(True)}),
          n as (select capture_id, count(*) as packets from packets group by capture_id)
          select capture_id, packets, packets < max(packets) over () as is_short, true as refused_above from n""",
    }
    return out
