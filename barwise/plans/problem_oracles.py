"""DuckDB SQL for the queries in :mod:`barwise.plans.problems` that SQL can express."""

_DAILY = """
    with d as (select symbol, bob::date as day, sum(close) filter (where not isnan(close)) as s,
                      count(close) filter (where not isnan(close)) as c, count(*) as n
               from bars where symbol is not null and bob is not null group by all),
    cal as (select symbol, unnest(generate_series(min(day), max(day), interval 1 day))::date as day from d group by symbol),
    t as (select cal.symbol, cal.day, coalesce(n, 0)::bigint as rows_day,
                 sum(s) over w7 as sum_7d, coalesce(sum(c) over w7, 0)::bigint as count_7d,
                 sum(s) over w30 as sum_30d, coalesce(sum(c) over w30, 0)::bigint as count_30d
          from cal left join d on d.symbol = cal.symbol and d.day = cal.day
          window w7 as (partition by cal.symbol order by cal.day rows between 6 preceding and current row),
                 w30 as (partition by cal.symbol order by cal.day rows between 29 preceding and current row))
"""
_MINUTES = """
    with u as (select symbol, epoch_us(created_at) as t, price as p, coalesce(case when isnan(last_volume) then null else last_volume end, 0) as q,
                      epoch_us(created_at) // 60000000 as m
               from ticks where symbol is not null and created_at is not null and price is not null and not isnan(price) and price > 0),
    g as (select symbol, unnest(range(min(m), max(m) + 1)) as g from u group by symbol, m // 1440)
"""
_ISLANDS = """
    with r as (select symbol, epoch_us(bob) as s, epoch_us(eob) as e from bars where symbol is not null and bob is not null and eob > bob),
    p as (select *, max(e) over (partition by symbol order by s, e rows between unbounded preceding and 1 preceding) as pe from r),
    n as (select *, (pe is null or s > pe)::int as nw from p)
"""

ORACLES = {
    "p5_found": _DAILY + "select symbol, strftime(day, '%Y-%m-%d') as day from t where count_7d = 0 and count_30d > 0",
    "p5_trailing": _DAILY
    + """select symbol, strftime(day, '%Y-%m-%d') as day, rows_day, round(sum_7d + 1e-9, 4) as sum_7d, count_7d,
         round(sum_7d / nullif(count_7d, 0) + 1e-9, 4) as avg_7d, round(sum_30d + 1e-9, 4) as sum_30d, count_30d,
         round(sum_30d / nullif(count_30d, 0) + 1e-9, 4) as avg_30d from t""",
    "p6_found": _MINUTES + "select g.symbol, g.g as epoch_minute from g left join (select distinct symbol, m from u) u on u.symbol = g.symbol and u.m = g.g where u.m is null",
    "p6_grid": _MINUTES
    + """, a as (
        select g.symbol, g.g, p, q, m = g.g as own, (t - (g.g * 60000000 + 30000000)) / 1e6 as x,
               1.0 - ((t - (g.g * 60000000 + 30000000)) / 1e6 / 180.0) * ((t - (g.g * 60000000 + 30000000)) / 1e6 / 180.0) as w
        from g join u on u.symbol = g.symbol and u.t between g.g * 60000000 - 150000000 and g.g * 60000000 + 210000000),
    f as (select symbol, g, sum(w) as s0, sum(w * x) as s1, sum(w * x * x) as s2, sum(w * w) as ww, sum(w * p) as t0, sum(w * x * p) as t1,
                 count(*) filter (where own) as n, sum(q) filter (where own) as vol, avg(p) filter (where own) as mean
          from a where w > 0 group by all),
    h as (select g.symbol, g.g, coalesce(n, 0)::bigint as readings, coalesce(vol, 0.0)::double as volume, coalesce(s0 * s0 / nullif(ww, 0), 0.0)::double as sup,
                 case when s0 * s2 - s1 * s1 > 1e-9 * s0 * s0 * 180.0 * 180.0 then (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) else t0 / nullif(s0, 0) end as fit, mean
          from g left join f on f.symbol = g.symbol and f.g = g.g)
    select symbol, g as epoch_minute, readings, volume, round(case when sup >= 2 then fit else mean end, 6) as price, round(sup, 6) as support,
           case when readings > 0 then 'observed' when sup >= 2 then 'filled' else 'missing' end as mark from h""",
    "p7_found": _ISLANDS
    + """select symbol, pe // 1000000 as gap_start, s // 1000000 as gap_end from n
         where nw = 1 and s - pe >= 2000000 and pe // 86400000000 = s // 86400000000""",
    "p7_periods": _ISLANDS
    + """, i as (select *, sum(nw) over (partition by symbol order by s, e rows unbounded preceding) as g from n)
         select symbol, min(s) // 1000000 as period_start, max(e) // 1000000 as period_end, count(*)::bigint as intervals from i group by symbol, g""",
}

_TICKS = """
    with v as (select record_id, payload::json as j from tick_payloads where json_valid(payload)),
    a as (select record_id, case when json_type(j) = 'ARRAY' then json_extract(j, '$[*]') else [j] end as roots from v),
    r as (select record_id, unnest(roots) as r, generate_subscripts(roots, 1) as gi from a),
    g as (select record_id, gi, coalesce(r->>'$.batch.symbol', r->>'$.symbol', r->>'$.meta.symbol') as outer_symbol,
                 case when json_type(r, '$.batch.ticks') = 'ARRAY' then json_extract(r, '$.batch.ticks[*]') when json_type(r, '$.ticks') = 'ARRAY' then json_extract(r, '$.ticks[*]')
                      when json_type(r, '$.data') = 'ARRAY' then json_extract(r, '$.data[*]') else [r] end as ticks from r where json_type(r) = 'OBJECT'),
    u as (select record_id, gi, outer_symbol, unnest(ticks) as t, generate_subscripts(ticks, 1) as ti from g),
    n as (select record_id, row_number() over (partition by record_id order by gi, ti) as tick_no, coalesce(t->>'$.symbol', outer_symbol) as symbol, t,
                 case when json_type(t, '$.quotes') = 'VARCHAR' then (t->>'$.quotes')::json else json_extract(t, '$.quotes') end as q from u)
"""
_LEVELS = (
    _TICKS
    + """, l as (select record_id, tick_no, symbol, unnest(json_extract(q, '$[*]')) as x, generate_subscripts(json_extract(q, '$[*]'), 1)::int as level_no from n where json_type(q) = 'ARRAY'
    union all select record_id, tick_no, symbol, json_extract(q, '$."' || k || '"') as x, k::int as level_no from (select *, unnest(json_keys(q)) as k from n where json_type(q) = 'OBJECT') where regexp_full_match(k, '[0-9]+')
    union all select record_id, tick_no, symbol, q as x, 1 as level_no from n where json_type(q) = 'OBJECT' and len(json_keys(q)) > 0 and not regexp_full_match(json_keys(q)[1], '[0-9]+'))
"""
)
ORACLES |= {
    "p1_found": _LEVELS + "select record_id, tick_no::int as tick_no, symbol, level_no from l where json_type(x) = 'OBJECT'",
    "p1_levels": _LEVELS
    + """select record_id, tick_no::int as tick_no, symbol, level_no, try_cast(x->>'$.bid_p' as double) as bid_p, try_cast(x->>'$.bid_v' as double) as bid_v,
         try_cast(x->>'$.ask_p' as double) as ask_p, try_cast(x->>'$.ask_v' as double) as ask_v from l where json_type(x) = 'OBJECT'""",
    "p1_ticks": _TICKS
    + """select record_id, tick_no::int as tick_no, symbol,
         case when regexp_full_match(t->>'$.created_at', '[0-9]{12,}') then make_timestamp((t->>'$.created_at')::bigint * 1000)
              else try_cast(replace(replace(t->>'$.created_at', 'Z', ''), 'T', ' ') as timestamp) end as created_at,
         """
    + ", ".join(f"try_cast(t->>'$.{c}' as double) as {c}" for c in ("price", "last_volume"))
    + ", try_cast(t->>'$.trade_type' as int) as trade_type, "
    + ", ".join(f"try_cast(t->>'$.{c}' as double) as {c}" for c in ("cum_volume", "cum_amount", "cum_position"))
    + " from n",
    "p1_records": _TICKS
    + """select p.record_id, coalesce(json_valid(payload), false) as valid, coalesce(c, 0)::bigint as ticks from tick_payloads p
         left join (select record_id, count(*) as c from n group by record_id) k on k.record_id = p.record_id""",
}

# The same judgement with exact quantiles in place of mergeable sketches (whose bins are 2 % wide).
ORACLES["p3_found"] = """
    with long as (
        select bar_id, symbol, bob, 'close' as field, close as v, coalesce(close <= 0 or close < low - 1e-9 * abs(close) or close > high + 1e-9 * abs(close), close <= 0) as bad from bars
        union all select bar_id, symbol, bob, 'volume', volume, volume < 0 from bars
        union all select bar_id, symbol, bob, 'position', position, position < 0 from bars),
    ok as (select * from long where v is not null and not isnan(v)),
    rep as (select symbol, field, bob, arg_min(v, bar_id) as y from ok where not bad and symbol is not null and bob is not null group by all),
    s as (select *, lag(y) over w as py, median(y) over (partition by symbol, field order by bob rows between 5 preceding and 5 following) as med, count(*) over (partition by symbol, field) as n
          from rep window w as (partition by symbol, field order by bob)),
    r as (select *, sum((py is null or y <> py)::int) over (partition by symbol, field order by bob rows unbounded preceding) as run from s),
    rl as (select symbol, field, run, count(*) as len from r group by all),
    ln0 as (select symbol, field, len, count(*) as c, lag(len) over w as below, sum(len * count(*)) over (w rows between unbounded preceding and 1 preceding) as bars, sum((len - 1) * count(*)) over (w rows between unbounded preceding and 1 preceding) as eq
            from rl group by symbol, field, len window w as (partition by symbol, field order by len)),
    fz as (select symbol, field, min(len) as least from ln0 where len > 2 * coalesce(below, 1) and (len >= 10 or (bars > 0 and bars * power((eq + 1) / (bars + 1), len - 1) < 1e-4)) group by all),
    ch as (select symbol, field, hour(bob) as h, y - py as d from s where py is not null and n >= 8),
    qs as (select symbol, field, coalesce(h, -1) as h, count(*) as hn, quantile_disc(d, 0.25) as q1, quantile_disc(d, 0.75) as q3, greatest(abs(quantile_disc(d, 0.25) filter (where d <> 0)), abs(quantile_disc(d, 0.75) filter (where d <> 0))) as m
           from ch group by grouping sets ((symbol, field, h), (symbol, field))),
    sc as (select symbol, field, h, q1 - k * sp as lo, q3 + k * sp as hi from (select *, case when q1 = q3 then m else q3 - q1 end as sp, case when h < 0 then case field when 'close' then 9.3 else 18 end else case field when 'close' then 4 else 8 end end as k
           from qs where h < 0 or hn >= 30) where sp is not null),
    z as (select *, ln(y) as lv, hour(bob) as h from s where field = 'volume' and y > 0),
    zs as (select symbol, quantile_disc(lv, 0.25) as s1, quantile_disc(lv, 0.75) as s3, count(*) as sn from z group by symbol),
    zh as (select symbol, h, quantile_disc(lv, 0.25) as h1, quantile_disc(lv, 0.75) as h3, count(*) as hn from z group by all),
    hits as (
        select symbol, field, bob, y from r join rl using (symbol, field, run) join fz using (symbol, field) where len >= least and y = py
        union select s.symbol, s.field, bob, y from s join sc on sc.symbol = s.symbol and sc.field = s.field and sc.h = -1 left join sc sh on sh.symbol = s.symbol and sh.field = s.field and sh.h = hour(bob)
              where s.field in ('close', 'position') and ((y - med > sc.hi and y - med > coalesce(sh.hi, '-infinity'::double)) or (y - med < sc.lo and y - med < coalesce(sh.lo, 'infinity'::double)))
        union select symbol, field, bob, y from z join zs using (symbol) join zh using (symbol, h)
              where sn >= 8 and lv > s3 + 3.4 * greatest(s3 - s1, 0.05) and (hn < 30 or lv > h3 + 2.6 * greatest(h3 - h1, 0.2)))
    select bar_id, field from ok where bad
    union select ok.bar_id, ok.field from ok join hits on hits.symbol = ok.symbol and hits.field = ok.field and hits.bob = ok.bob and hits.y = ok.v
"""
