"""The checking SQL, one text per query, over the same tables. Shared steps are named fragments."""

from __future__ import annotations

from tideline.operators.curves import CLOCK_PROBS, EVENT_PROBS
from tideline.sources.views import sql

T0, H, REPS, FREPS, EREPS, SHIFTS, LAGS, DEPTH = 1704067200000000, 3600000000, 1000, 2000, 2000, 20, 168, 25
NB = len(EVENT_PROBS) + 1

PARTS: dict[str, str] = {n: sql(n).strip() for n in ("trades", "quotes", "l2", "order_feed", "bands", "equity_messages", "equity_books")}
SIGNED = "case when is_buyer_maker then -qty_lots else qty_lots end"
PARTS |= {
    "tr": f"select *, {SIGNED} as sq, (row_number() over (partition by symbol, day order by ts_us, id)-1)//25 as g from trades",
    "gb": "select symbol, day, g, min(ts_us) as t, arg_min(price_ticks, ts_us) as p0, cast(sum(sq) as bigint) as q, count(*) as n from tr group by symbol, day, g",
    "gr": "select *, lead(ln(p0)) over (partition by symbol, day order by g) - ln(p0) as r from gb",
    "blocks": "select symbol, day, cast(row_number() over (partition by symbol, day order by g)-1 as bigint) as bi, t, q, r from gr where n=25 and r is not null",
    "bars": f"select symbol, ts_us - ts_us%60000000 as m, cast(sum({SIGNED}) as bigint) as ofi, arg_min(price_ticks, ts_us) as p0, count(*) as n from trades group by 1, 2",
    "barr": "select *, case when lead(m) over w = m+60000000 then lead(ln(p0)) over w - ln(p0) end as r from bars window w as (partition by symbol order by m)",
    "edges": f"select symbol, [round(x, 6) for x in quantile_cont(q, {EVENT_PROBS})] as e from blocks group by symbol",
    "binned": "select b.*, len([x for x in e if x <= q]) as bin from blocks b join edges using (symbol)",
    "cube": f"select symbol, (t-{T0})//{H} as h, bin, count(*) as n, cast(sum(q) as bigint) as sq, sum(r) as sr, sum(r*r) as sr2 from binned group by 1, 2, 3",
    "curve": "select symbol, bin, cast(sum(n) as bigint) as n, sum(sq)/sum(n) as mean_q, sum(sr)/sum(n) as mean_r, case when sum(n)>1 then sqrt(greatest(sum(sr2)/sum(n)-(sum(sr)/sum(n))*(sum(sr)/sum(n)), 0.0)) end as sd_r from cube group by 1, 2",
    "lims": "select symbol, quantile_cont(abs(q), [0.1, 0.9]) as lim from blocks group by symbol",
    "inner_curve": "select c.*, abs(mean_q) between lim[1] and lim[2] as inside from curve c join lims using (symbol)",
    "hours": "select distinct symbol, h from (select distinct symbol from blocks), range(720) t(h)",
    "flow": f"select symbol, h, coalesce(flow, 0) as flow from hours left join (select symbol, (t-{T0})//{H} as h, cast(sum(q) as bigint) as flow from blocks group by 1, 2) using (symbol, h)",
    "dev": "select symbol, h, flow - avg(flow) over (partition by symbol) as x from flow",
    "acf": f"select a.symbol, k as lag, sum(a.x*b.x)/any_value(d) as acf from dev a, range({LAGS + 1}) t(k), dev b, (select symbol as s, sum(x*x) as d from dev group by 1) where b.symbol=a.symbol and b.h=a.h+k and s=a.symbol group by 1, 2",
    "ix": "select *, row_number() over (partition by symbol order by day, t)-1 as i, count(*) over (partition by symbol) as total from binned",
    "moved": f"select symbol, s as shift_no, bin, (i + greatest(1, total//181) + (((s+1)*2654435761)%4294967296)//65536 % greatest(1, total-2*greatest(1, total//181))) % total as i from ix, range({SHIFTS}) t(s)",
    "pairs": "select m.symbol, shift_no, i, m.bin, r from moved m join ix using (symbol, i)",
    "placebo": "select symbol, shift_no, bin, count(*) as n, avg(r) as mean_r from pairs group by 1, 2, 3",
    "lens": f"select symbol, greatest(h, 9) as l from (select symbol, coalesce(min(case when good then lag end), {LAGS}) as h from (select symbol, lag, abs(acf)<2/sqrt(720) and lead(abs(acf)<2/sqrt(720), 1) over w and lead(abs(acf)<2/sqrt(720), 2) over w and lag between 1 and {LAGS - 3} as good from acf window w as (partition by symbol order by lag)) group by 1)",
    "mids": "select *, (bid_ticks+ask_ticks)/2 as mid from quotes",
    "bm": "select b.*, mid from blocks b asof left join mids q on b.symbol=q.symbol and b.t>=q.ts_us",
    "proxy": "select * from (select *, lead(ln(mid)) over (partition by symbol order by day, bi) - ln(mid) as r_mid from bm) where r_mid is not null",
    "pedges": f"select symbol, [round(x, 6) for x in quantile_cont(q, {EVENT_PROBS})] as e from proxy group by symbol",
    "pb": "select p.*, len([x for x in e if x <= q]) as bin from proxy p join pedges using (symbol)",
    "spine": f"select symbol, unnest(range(t0, t1+{H}+1, {H})) as edge from (select symbol, min(ts_us) as t0, max(ts_us) as t1 from trades group by 1)",
    "ep": "select e.symbol, edge, price_ticks from spine e asof left join trades t on e.symbol=t.symbol and e.edge>=t.ts_us",
    "resp": "select symbol, bin_start, response from (select symbol, edge as bin_start, lead(edge) over w as nx, lead(ln(price_ticks)) over w - ln(price_ticks) as response from ep window w as (partition by symbol order by edge)) where nx is not null",
    "bflow": f"select symbol, bin_start, coalesce(ofi, 0) as ofi, coalesce(n_trades, 0) as n_trades from resp left join (select symbol, t0+(ts_us-t0)//{H}*{H} as bin_start, cast(sum({SIGNED}) as bigint) as ofi, count(*) as n_trades from trades join (select symbol, min(ts_us) as t0 from trades group by 1) using (symbol) group by 1, 2) using (symbol, bin_start)",
    "rv": "select symbol, day, round(sum(r*r), 12) as rv from blocks group by 1, 2",
    "rvl": "select *, case when rv <= lim[1]+1e-15 then 0 when rv <= lim[2]+1e-15 then 1 else 2 end as tercile from rv join (select symbol, quantile_cont(rv, [1.0/3, 2.0/3]) as lim from rv group by 1) using (symbol)",
    "hc": f"select symbol, m//{H}%24 as hour, cast(sum(n) as bigint) as trades from bars group by 1, 2",
    "hcl": "select *, case when trades <= lim[1]+1e-15 then 0 when trades <= lim[2]+1e-15 then 1 else 2 end as tercile from hc join (select symbol, quantile_cont(trades, [1.0/3, 2.0/3]) as lim from hc group by 1) using (symbol)",
    "l2e": "select *, coalesce(max(case when is_snapshot then batch end) over (partition by symbol order by batch range between unbounded preceding and current row), -1) as episode from l2",
    "st": "select *, lead(batch) over (partition by symbol, episode, side, price order by batch, seq) as until, lag(amount) over (partition by symbol, episode, side, price order by seq) as prev from l2e",
    "every": "select distinct symbol, batch, episode from l2e",
    "bk": "select s.symbol, e.batch, side, price, amount as size from st s join every e on s.symbol=e.symbol and s.episode=e.episode and s.batch<=e.batch and (until is null or until>e.batch) where amount>0",
    "rk": "select *, cast(row_number() over (partition by symbol, batch, side order by case when side=0 then -price else price end)-1 as int) as rank from bk",
    "top": f"select * from rk where rank<{DEPTH}",
    "pub0": "select *, max(rank) over (partition by symbol, batch, side) as deepest from top",
    "pub1": "select symbol, batch, side, case when rank=1 and side=0 and batch%60=0 then price-1 else price end as price, case when rank=3 and batch%50=0 then size+1 else size end as size, rank, side=1 and rank=deepest as at_end from pub0",
    "pub": f"select symbol, batch, side, price, size, rank from pub1 where not (at_end and batch%70=0 and not (batch%110=0 and rank<{DEPTH - 1})) union all select symbol, batch, side, price+1, 1, rank+1 from pub1 where at_end and batch%110=0 and rank<{DEPTH - 1}",
    "cmp0": "select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.batch, b.batch) as batch, coalesce(a.side, b.side) as side, coalesce(a.rank, b.rank) as rank, case when a.price is null then 'EngineShallow' when b.price is null then 'EngineDeep' when a.price<>b.price then 'PriceDiffers' when a.size<>b.size then 'SizeDiffers' end as cls from top a full join pub b on a.symbol=b.symbol and a.batch=b.batch and a.side=b.side and a.rank=b.rank",
    "cmp": "select symbol, batch, coalesce(arg_min(cls, rank*2+1-side) filter (where cls is not null), 'None') as class, min(rank) filter (where cls is not null) as rank, coalesce(min(rank) filter (where cls is not null)<>0, true) as touch_exact from cmp0 group by 1, 2",
    "snaps": "select * from (select epoch_us(hour_ts) as ts, band, pct_tenths, depth_lots as depth from bands) asof join (select ts_us, cast(price_ticks as double) as mid from trades where symbol='AAA') on ts>=ts_us",
    "hs": "select ts, row_number() over (order by ts)-1 as i, count(*) over () as n from (select distinct ts from snaps)",
    "slices": "select cast(s as int) as slice, ts from range(12) t(s), hs where i=cast(floor(s*(n-1)/11+0.5) as bigint)",
    "buy": "select *, depth*5e-1 as avail, coalesce(sum(depth*5e-1) over (partition by ts order by band rows between unbounded preceding and 1 preceding), 0) as before from snaps where band>=6",
    "msgs": "select *, lag(size) over w as ps, lag(type) over w as pt from order_feed window w as (partition by symbol, order_id order by seq)",
}


def tagged(hours: tuple[int, ...]) -> str:
    pre = ", ".join(str((h - 1) % 24) for h in hours)
    return f"select symbol, m, ofi, p0, n, r, m//{H}%24 as hour, case when m//60000000%60>=55 then 'pre_funding' else 'control' end as \"window\", m//86400000000 as day from barr where r is not null and m//{H}%24 in ({pre}) and (m//60000000%60>=55 or m//60000000%60 between 25 and 29)"


def did(hours: tuple[int, ...]) -> str:
    s = "select symbol, rep, \"window\", sum(n*w) as n, sum(ao*w) as ao, sum(ar*w) as ar, sum(x*w) as x, sum(y*w) as y, sum(xx*w) as xx, sum(xy*w) as xy from (select symbol, day, \"window\", count(*) as n, sum(abs(ofi))*1.0 as ao, sum(abs(r)) as ar, sum(ofi)*1.0 as x, sum(r) as y, sum(ofi*ofi)*1.0 as xx, sum(ofi*r) as xy from (%s) group by 1, 2, 3) join days using (symbol, day) join dw using (i) group by 1, 2, 3" % tagged(hours)
    v = f"select symbol, rep, \"window\", ao/n as mean_abs_ofi, ar/n as mean_abs_r, case when n>2 and n*xx-x*x<>0 then (n*xy-x*y)/(n*xx-x*x) end as slope from ({s})"
    at = lambda c: f"max(case when \"window\"='pre_funding' then {c} end) - max(case when \"window\"='control' then {c} end) as d_{c}"
    return f"select symbol, rep, {at('mean_abs_ofi')}, {at('mean_abs_r')}, {at('slope')} from ({v}) group by 1, 2"


PARTS |= {
    "days": "select symbol, day, row_number() over (partition by symbol order by day)-1 as i from (select distinct symbol, m//86400000000 as day from bars)",
    "dw": f"select rep, ((((rep*7919+j*104729+17)*2654435761)%4294967296)//65536)%30 as i, count(*) as w from range({FREPS}) a(rep), range(30) b(j) group by 1, 2",
    "did_f": did((0, 8, 16)), "did_o": did((4, 12, 20)), "tagged": tagged((0, 8, 16)),
}



def estimators(p: str, source: str, probs: list[float], extra: str = "") -> dict[str, str]:
    """Edges, bins, cube, curve and interior of windows (symbol, t, q, r) under names that begin with p."""
    return {
        f"{p}_edges": f"select symbol, [round(x, 6) for x in quantile_cont(q, {probs})] as e from {source} group by symbol",
        f"{p}_binned": f"select b.*, len([x for x in e if x <= q]) as bin from {source} b join {p}_edges using (symbol)",
        f"{p}_cube": f"select symbol, (t-{T0})//{H} as h, bin, count(*) as n, sum(q)*1.0 as sq, sum(r) as sr, sum(r*r) as sr2 from {p}_binned group by 1, 2, 3",
        f"{p}_curve": f"select symbol, bin, cast(sum(n) as bigint) as n, sum(sq)/sum(n) as mean_q, sum(sr)/sum(n) as mean_r, case when sum(n)>1 then sqrt(greatest(sum(sr2)/sum(n)-(sum(sr)/sum(n))*(sum(sr)/sum(n)), 0.0)) end as sd_r from {p}_cube group by 1, 2",
        f"{p}_lims": f"select symbol, quantile_cont(abs(q), [0.1, 0.9]) as lim from {source} group by symbol",
        f"{p}_inner": f"select c.*, abs(mean_q) between lim[1] and lim[2] as inside from {p}_curve c join {p}_lims using (symbol)",
    }


def weights(rings: str, lens: str, reps: int) -> str:
    """(symbol, ring, rep, h, w) of rings (symbol, ring, i, h, k): draws of the moving-block bootstrap."""
    size = f"select symbol, ring, max(k) as k, any_value(l) as l from {rings} join {lens} using (symbol) group by 1, 2 having max(k)>=3*any_value(l) or ring='all'"
    drawn = f"select symbol, ring, k, l, rep, unnest(range(cast(ceil(k/l) as bigint))) as j from ({size}), range({reps}) a(rep)"
    starts = f"select symbol, ring, k, rep, ((((rep*7919+j*104729+17)*2654435761)%4294967296)//65536)%k as start, unnest(range(l)) as o from ({drawn})"
    return f"select symbol, ring, rep, h, count(*) as w from (select symbol, ring, rep, (start+o)%k as i from ({starts})) join {rings} using (symbol, ring, i) group by 1, 2, 3, 4"


def replicates(cube: str, w: str) -> str:
    return f"select symbol, ring, rep, bin, sum(sr*w)/sum(n*w) as mean_r from {cube} join {w} using (symbol, h) group by 1, 2, 3, 4"


def whole(source: str) -> str:
    return f"select symbol, 'all' as ring, h as i, h, 720 as k from (select distinct symbol from {source}), range(720) t(h)"


def stats(reps: str, curve: str, by: str = "symbol, ring") -> str:
    """Exponent, slope and turnover of every replicate over the inside bins of the curve."""
    like, use = "inside and sign(mean_r)=sign(mean_q) and mean_r<>0", "inside and mean_r is not null"
    at = lambda k: f"max(case when bin={k} then abs(mean_r) end)"
    return (
        f"select {by}, rep, case when count(*) filter (where {like})>=3 then regr_slope(ln(abs(mean_r)), ln(abs(mean_q))) filter (where {like}) end as gamma, case when count(*) filter (where {use})>=3 then regr_slope(mean_r, mean_q) filter (where {use}) end as slope, "
        f"{at(0)}-{at(1)} as sell_side, {at(NB - 1)}-{at(NB - 2)} as buy_side from (select p.*, c.mean_q, c.inside from {reps} p join {curve} c using ({by}, bin)) group by {by}, rep"
    )


PARTS |= {
    "rings0": whole("blocks"), "weights": weights("rings0", "lens", REPS), "reps": replicates("cube", "weights"),
    "bands_ci": "select symbol, bin, quantile_cont(mean_r, 0.025) as lo, quantile_cont(mean_r, 0.975) as hi from reps where mean_r is not null group by 1, 2",
    "ring_curve0": "select *, 'all' as ring from inner_curve", "stat0": stats("reps", "ring_curve0"),
    "spine_h": "select symbol, h from (select distinct symbol from blocks), range(720) t(h)",
    "rr": "select symbol, case tercile when 0 then 'vol_low' when 1 then 'vol_mid' else 'vol_high' end as ring, h from spine_h join rvl using (symbol) where rvl.day=date '2024-01-01'+cast(h//24 as int) union all select symbol, case tercile when 0 then 'activity_low' when 1 then 'activity_mid' else 'activity_high' end, h from spine_h join hcl using (symbol) where h%24=hour",
    "rings": "select symbol, ring, row_number() over (partition by symbol, ring order by h)-1 as i, h, count(*) over (partition by symbol, ring) as k from rr",
    "rw": weights("rings", "lens", REPS), "rreps": replicates("cube", "rw"),
    "rcurve": "select symbol, ring, bin, cast(sum(n) as bigint) as n, sum(sq)/sum(n) as mean_q, sum(sr)/sum(n) as mean_r, case when sum(n)>1 then sqrt(greatest(sum(sr2)/sum(n)-(sum(sr)/sum(n))*(sum(sr)/sum(n)), 0.0)) end as sd_r from cube join rings using (symbol, h) group by 1, 2, 3",
    "rinner": "select c.*, abs(mean_q) between lim[1] and lim[2] as inside from rcurve c join lims using (symbol) where (symbol, ring) in (select distinct symbol, ring from rw)",
    "rstat": stats("rreps", "rinner"),
    "rsum": "select symbol, ring, hours, windows, amplitude, slope from (select symbol, ring, count(*) as hours from rings where (symbol, ring) in (select distinct symbol, ring from rw) group by 1, 2) left join (select symbol, ring, cast(sum(n) as bigint) as windows, max(abs(mean_r)) as amplitude, case when count(*) filter (where inside and mean_r is not null)>=3 then regr_slope(mean_r, mean_q) filter (where inside and mean_r is not null) end as slope from rinner group by 1, 2) using (symbol, ring)",
    "rci": "select symbol, ring, quantile_cont(slope, 0.025) as slope_lo, quantile_cont(slope, 0.975) as slope_hi from rstat where slope is not null group by 1, 2",
    "ewin": " union all ".join(f"select symbol||'|N={25 * m}' as symbol, day, min(t) as t, cast(sum(q) as bigint) as q, sum(r) as r from blocks group by symbol, day, bi//{m} having count(*)={m}" for m in (1, 10, 100, 1000)),
    "ewd": "select *, last_value(d ignore nulls) over (partition by symbol order by day, t rows between unbounded preceding and current row) as dt_s from (select *, case when lead(day) over w=day then (lead(t) over w-t)/1e6 end as d from ewin window w as (partition by symbol order by day, t))",
    "cwd": "select symbol||'|1min' as symbol, cast(null as date) as day, m as t, ofi as q, r, cast(null as double) as dt_s from barr where r is not null",
    **estimators("e", "ewd", EVENT_PROBS), **estimators("c", "cwd", CLOCK_PROBS),
}
for _p, _src in (("e", "ewd"), ("c", "cwd")):
    PARTS |= {
        f"{_p}_lens": f"select distinct w.symbol, l from {_src} w join lens on split_part(w.symbol, '|', 1)=lens.symbol", f"{_p}_rings": whole(_src), f"{_p}_w": weights(f"{_p}_rings", f"{_p}_lens", REPS),
        f"{_p}_reps": replicates(f"{_p}_cube", f"{_p}_w"), f"{_p}_ci": f"select symbol, bin, quantile_cont(mean_r, 0.025) as lo, quantile_cont(mean_r, 0.975) as hi from {_p}_reps where mean_r is not null group by 1, 2",
        f"{_p}_stat": f"select symbol, bin, avg(case when r=0 then 1 else 0 end) as fz, avg(dt_s) as dt from {_p}_binned group by 1, 2",
        f"{_p}_table": f"select split_part(symbol, '|', 1) as symbol, split_part(symbol, '|', 2) as scale, bin, n as n_windows, round(mean_q, 7) as mean_q, round(mean_r, 7) as mean_r, round(lo, 7) as ci_lo, round(hi, 7) as ci_hi, round(sd_r, 7) as sd_r, round(fz, 7) as frac_zero_r, round(dt, 7) as mean_duration_s, inside as interior_bin from {_p}_inner left join {_p}_ci using (symbol, bin) left join {_p}_stat using (symbol, bin)",
    }
PARTS |= {
    "eqm": "select symbol, day, row_index, (ask+bid)/2/10000 as midprice, (ask-bid)/10000 as spread from equity_books",
    "eqt": "select m.symbol, m.day, m.row_index, date_diff('day', date '1970-01-01', m.day)*86400000000+cast(trunc(seconds*1e6) as bigint) as t, cast(-direction*size as double) as signed_qty, price/10000 as trade_price, midprice, spread, type=5 as is_hidden from equity_messages m left join eqm using (symbol, day, row_index) where type in (4, 5)",
    "eqg": "select *, (row_number() over (partition by symbol, day order by row_index)-1)//25 as g from eqt",
    "eqb": "select symbol, day, g, arg_min(t, row_index) as t, arg_min(trade_price, row_index) as p0, (list(midprice order by row_index))[1] as m0, sum(signed_qty) as q, count(*) as n from eqg group by 1, 2, 3",
    "eqr": "select *, lead(ln(p0)) over w-ln(p0) as r, lead(ln(m0)) over w-ln(m0) as r_mid from eqb window w as (partition by symbol, day order by g)",
    "eqk": "select symbol, day, cast(row_number() over (partition by symbol, day order by g)-1 as bigint) as bi, t, q, r, r_mid from eqr where n=25 and r is not null and r_mid is not null",
    "eqflow": f"select symbol, h, coalesce(flow, 0) as flow from (select symbol, h from (select distinct symbol from eqk), range(720) t(h)) left join (select symbol, (t-{T0})//{H} as h, sum(q) as flow from eqk group by 1, 2) using (symbol, h)",
    "eqdev": "select symbol, h, flow - avg(flow) over (partition by symbol) as x from eqflow",
    "eqacf": f"select a.symbol, k as lag, sum(a.x*b.x)/any_value(d) as acf from eqdev a, range({LAGS + 1}) t(k), eqdev b, (select symbol as s, sum(x*x) as d from eqdev group by 1) where b.symbol=a.symbol and b.h=a.h+k and s=a.symbol group by 1, 2",
    "eqlens": PARTS["lens"].replace("from acf window", "from eqacf window"),
    "eqrings": whole("eqk"), "eqw": weights("eqrings", "eqlens", EREPS),
}
for _p, _r in (("mid", "r_mid"), ("trade", "r"), ("diff", "r-r_mid")):
    PARTS |= {f"q{_p}": f"select symbol, t, q, {_r} as r from eqk"} | estimators(f"q{_p}", f"q{_p}", EVENT_PROBS) | {f"q{_p}_reps": replicates(f"q{_p}_cube", "eqw"), f"q{_p}_ci": f"select symbol, bin, quantile_cont(mean_r, 0.025) as lo, quantile_cont(mean_r, 0.975) as hi from q{_p}_reps where mean_r is not null group by 1, 2", f"q{_p}_x": f"select symbol, '{_p}' as response, bin, n, mean_q, mean_r, lo, hi from q{_p}_curve left join q{_p}_ci using (symbol, bin)"}
PARTS |= {
    "qmid_in": "select *, 'all' as ring from qmid_inner", "qstat": stats("qmid_reps", "qmid_in"),
    "pdiff": "select symbol, t, q, r-r_mid as r from proxy", **estimators("p", "pdiff", EVENT_PROBS), "one": "select distinct symbol, 1 as l from proxy", "prings": whole("proxy"), "pw": weights("prings", "one", REPS), "preps": replicates("p_cube", "pw"),
    "p_ci": "select symbol, bin, quantile_cont(mean_r, 0.025) as lo, quantile_cont(mean_r, 0.975) as hi from preps where mean_r is not null group by 1, 2",
    "steps": "select *, coalesce(case when prev>0 then prev end, 0) as old from st",
    "acts": "select symbol, batch, seq, ts_us, side, price, amount, case when is_snapshot then case when amount>0 then 1+side end when amount<=0 then case when old>0 then 1 end when old>0 and amount<old then 1 when old>0 and amount=old then null else 2 end as phase, case when is_snapshot then 0 when amount<=0 then 2 when old>0 then 1 else 0 end as type, is_snapshot from steps",
    "sent": "select symbol, batch, seq, ts_us, 2*price+side as order_id, case when type=0 then price else 0 end as price, case when type=2 then 0 else amount end as size, type, side, phase from acts where phase is not null union all select distinct symbol, batch, -1, ts_us, 0, 0, 0, 4, 0, 0 from l2 where is_snapshot",
    "bk1": "select symbol, batch, side, price, cast(sum(size) as bigint) as size from (select symbol, batch, side, price, size from bk union all select distinct symbol, batch, 0, 9990, 3 from bk) group by 1, 2, 3, 4",
    "rk1": "select *, cast(row_number() over (partition by symbol, batch, side order by case when side=0 then -price else price end)-1 as int) as rank from bk1",
    "nextb": "select symbol, batch, lead(batch) over (partition by symbol order by batch) as nb from (select distinct symbol, batch from bk)",
    "step0": "select coalesce(a.symbol, b.symbol) as symbol, coalesce(a.batch, b.batch) as batch, coalesce(a.rank, b.rank) as rank, coalesce(a.side, b.side) as side, case when a.price is null then 'EngineShallow' when b.price is null then 'EngineDeep' when a.price<>b.price then 'PriceDiffers' when a.size<>b.size then 'SizeDiffers' end as cls from (select r.* from rk1 r join nextb using (symbol, batch) where nb is not null and rank<10) a full join (select r.symbol, n.batch, r.side, r.price, r.size, r.rank from rk r join nextb n on r.symbol=n.symbol and r.batch=n.nb where r.rank<10) b on a.symbol=b.symbol and a.batch=b.batch and a.side=b.side and a.rank=b.rank",
}

ORDER, FILL = "struct(side int, price bigint, pri bigint, oid bigint, size bigint)", "struct(nth bigint, oid bigint, price bigint, size bigint)"


def engine(messages: str, name: str = "eng", feed: bool = False) -> str:
    """Body of the recursive part ``name``: the matching engine's state after each of the messages (symbol, k from 1, seq, ts_us, type, oid, side, price, size).

    The book is a list of orders with the seq of their place in the queue. With ``feed`` types are those of an order feed (1 new, 2 cancel, 3 delete, 4 and 5 executions) over orders that it names itself,
    and become messages by what rests: kind is the feed's type then, and type -2 sends nothing.
    """
    order = lambda side, price, pri, oid, size: f"{{'side': {side}, 'price': {price}, 'pri': {pri}, 'oid': {oid}, 'size': {size}}}"
    new = "m.type=1" if feed else "m.type=0"
    first = f"select symbol, cast(0 as bigint) as k, cast(0 as bigint) as seq, cast(0 as bigint) as ts_us, -1 as type, cast(0 as bigint) as oid, 0 as side, cast([] as {ORDER}[]) as book, cast([] as {FILL}[]) as fills, true as ok, cast(0 as bigint) as added, cast(0 as bigint) as removed, false as crossed, -1 as kind, false as known from (select distinct symbol from {messages})"
    opposite = f"list_sort([{{'key': case when m.side=0 then o.price else -o.price end, 'pri': o.pri, 'oid': o.oid, 'price': o.price, 'size': o.size}} for o in s.book if {new} and o.side<>m.side and case when m.side=0 then o.price<=m.price else o.price>=m.price end])"
    joined = f"select m.*, s.book as book, list_filter(s.book, lambda o: o.oid=m.oid)[1] as cur, {opposite} as opp from {name} s join {messages} m on m.symbol=s.symbol and m.k=s.k+1"
    if feed:
        joined = f"select * exclude (type, size), type as kind, cast(case when type=1 then 0 when type=5 then 3 when cur is null then -2 when type=3 or size>=cur.size then 2 else 1 end as int) as type, case when type in (2, 4) and size<cur.size then cur.size-size else size end as size from ({joined})"
    else:
        joined = f"select *, type as kind from ({joined})"
    decided = f"select *, case type when 0 then size>0 and cur is null when 1 then cur is not null when 2 then cur is not null else true end as ok, len(opp)>0 as crossed, cur is not null as known from ({joined})"
    taken = "least(opp[i].size, size-coalesce(list_sum([o.size for o in opp[:i-1]]), 0))"
    filled = f"select *, cast(case when type=0 and ok then list_filter([{{'nth': i, 'oid': opp[i].oid, 'price': opp[i].price, 'size': {taken}}} for i in range(1, len(opp)+1)], lambda f: f.size>0) else [] end as {FILL}[]) as fills from ({decided})"
    summed = f"select *, size-coalesce(list_sum([f.size for f in fills]), 0) as rest from ({filled})"
    lowered = "list_filter([" + order("o.side", "o.price", "o.pri", "o.oid", "o.size-coalesce(list_sum([f.size for f in fills if f.oid=o.oid]), 0)") + " for o in book], lambda o: o.size>0)"
    changed = "[" + order("o.side", "o.price", "case when o.oid=oid and size>o.size then seq else o.pri end", "o.oid", "case when o.oid=oid then size else o.size end") + " for o in book]"
    book = f"case when not ok then book when type=0 then list_concat({lowered}, case when rest>0 then [{order('side', 'price', 'seq', 'oid', 'rest')}] else [] end) when type=2 or (type=1 and size<=0) then list_filter(book, lambda o: o.oid<>oid) when type=1 then {changed} when type=4 then [] else book end"
    added = "case when ok and type=0 then size when ok and type=1 and size>cur.size then size else 0 end"
    removed = "case when not ok then 0 when type=1 then case when size<=0 or size>cur.size then cur.size else cur.size-size end when type=2 then cur.size when type=4 then coalesce(list_sum([o.size for o in book]), 0) else 0 end"
    return f"{first} union all select symbol, k, seq, ts_us, type, oid, side, cast({book} as {ORDER}[]), fills, ok, cast({added} as bigint), cast({removed} as bigint), crossed, kind, known from ({summed})"


MESSAGES = "select symbol, row_number() over (partition by symbol order by seq) as k, seq, ts_us, type, order_id as oid, side, price, size from"
PARTS |= {
    "ms": f"{MESSAGES} order_feed", "eng": engine("ms"), "fl": "select symbol, seq, ts_us, oid as aggressor, side, unnest(fills) as f from eng",
    "ioc": "select symbol, max(seq)+1 as seq, max(ts_us) as ts_us from order_feed group by 1",
    "ims": f"{MESSAGES} (select symbol, seq, ts_us, type, order_id, side, price, size from order_feed union all select symbol, seq, ts_us, 0, cast(1 as bigint)<<60, 0, cast(1 as bigint)<<60, 25 from ioc union all select symbol, seq+1, ts_us, 2, cast(1 as bigint)<<60, 0, cast(1 as bigint)<<60, 25 from ioc)",
    "ieng": engine("ims", "ieng"),
    "fms": f"{MESSAGES.replace('type,', '[1, 2, 3, 4, 5][type+1] as type,')} order_feed", "feng": engine("fms", "feng", True),
    "totals": "select symbol, count(*) as messages, count(*) filter (where ok and type=0) as adds, count(*) filter (where ok and type=1) as modifies, count(*) filter (where ok and type=2) as deletes, count(*) filter (where type=3) as trades, count(*) filter (where type=4) as snapshot_resets, count(*) filter (where not ok) as rejected, cast(sum(added) as bigint) as qty_added, cast(sum(coalesce(list_sum([f.size for f in fills]), 0)) as bigint) as qty_filled, cast(sum(removed) as bigint) as qty_removed, cast(sum(len(fills)) as bigint) as fills, cast(coalesce(list_sum([o.size for o in arg_max(book, k)]), 0) as bigint) as resting from eng where k>0 group by 1",
    "ftotals": "select symbol, count(*) as rows, count(*) filter (where kind=1) as adds, count(*) filter (where kind=1 and crossed) as crossing_adds, count(*) filter (where kind=2 and known) as partial_cancels, count(*) filter (where kind=3 and known) as deletions, count(*) filter (where kind=4 and known and type=1) as executions, count(*) filter (where kind=4 and known and type=2) as execution_deletes, count(*) filter (where kind=5) as hidden, count(*) filter (where kind in (2, 3, 4) and not known) as unknown, count(*) filter (where type>=0)+count(*) filter (where kind=4 and known) as engine_messages, count(*) filter (where ok and type=0) as engine_adds, count(*) filter (where ok and type=1) as engine_modifies, count(*) filter (where ok and type=2) as engine_deletes, count(*) filter (where kind=5 or (kind=4 and known)) as engine_trades, count(*) filter (where not ok) as engine_rejected, cast(sum(added) as bigint) as engine_qty_added, cast(sum(coalesce(list_sum([f.size for f in fills]), 0)) as bigint) as engine_qty_filled, cast(sum(removed) as bigint) as engine_qty_removed, cast(sum(len(fills)) as bigint) as fills, cast(coalesce(list_sum([o.size for o in arg_max(book, k)]), 0) as bigint) as resting, cast(0 as bigint) as init_levels, cast(0 as bigint) as halts, cast(0 as bigint) as absorptions, cast(0 as bigint) as shortfall, cast(0 as bigint) as seed_deletes, cast(0 as bigint) as engine_snapshot_resets, cast(0 as bigint) as residual from feng where k>0 group by 1",
    "lines": "select symbol, string_agg(concat_ws(',', ts_us, aggressor, f.oid, f.price, f.size, side)||chr(10), '' order by seq, f.nth) as s, count(*) as fills, cast(sum(f.size) as bigint) as filled from fl group by 1",
}

LEVEL = "struct(side int, price bigint, known bigint, size bigint)"


def level_steps(rows: str, name: str = "lv") -> str:
    """Body of the recursive part ``name``: the two-pass adapter's levels (what it knows, what the engine holds) after every step (symbol, k from 1, batch, is_snapshot, phase, head, seq, side, price, amount)."""
    level = lambda side, price, known, size: f"{{'side': {side}, 'price': {price}, 'known': {known}, 'size': {size}}}"
    first = f"select symbol, cast(0 as bigint) as k, cast(-1 as bigint) as batch, cast([] as {LEVEL}[]) as levels, cast([] as bigint[]) as later, '' as act, cast(0 as bigint) as evicted, 0 as rejected from (select distinct symbol from {rows})"
    joined = f"select r.*, case when head and r.is_snapshot then [] else s.levels end as levels, case when head then [] else s.later end as later from {name} s join {rows} r on r.symbol=s.symbol and r.k=s.k+1"
    found = f"select *, list_filter(levels, lambda l: l.side=side and l.price=price)[1] as me from ({joined})"
    old = "coalesce(me.known, 0)"
    act = f"case when is_snapshot then case when phase=2 and amount>0 then 'adds' when phase=1 and amount<=0 then 'zero_rows' else '' end when phase=1 then case when amount<=0 then case when {old}>0 then 'deletes' else 'unknown_deletes' end when amount<{old} then 'shrinks' else 'later' end when list_contains(later, seq) then case when {old}=0 then 'adds' when amount>{old} then 'grows' else 'no_ops' end else '' end"
    acted = f"select *, {act} as act from ({found})"
    crossing = "case when {s}=0 then l.price<={p} else l.price>={p} end".format(s="side", p="price")
    cleared = f"select *, case when act='adds' then list_filter(levels, lambda l: l.side<>side and ({crossing})) else [] end as gone from ({acted})"
    rest = f"list_filter(levels, lambda l: not (l.side=side and l.price=price) and not (act='adds' and l.side<>side and ({crossing})))"
    new = f"case when act='adds' then list_append({rest}, {level('side', 'price', 'amount', 'coalesce(me.size, amount)')}) when act in ('shrinks', 'grows') then list_append({rest}, {level('side', 'price', 'amount', 'amount')}) when act='deletes' then {rest} else levels end"
    return f"{first} union all select symbol, k, batch, cast({new} as {LEVEL}[]), cast(case when act='later' then list_append(later, seq) else later end as bigint[]), act, cast(len(gone) as bigint), case when act='adds' and me.size is not null then 1 else 0 end from ({cleared})"


PARTS |= {
    "l2_hazard": sql("l2_hazard").strip(),
    "lrows": "select *, row_number() over (partition by symbol order by batch, phase, o, seq) as k, row_number() over (partition by symbol, batch order by phase, o, seq)=1 as head from (select *, unnest([1, 2]) as phase, case when is_snapshot then side else 0 end as o from l2_hazard)",
    "lv": level_steps("lrows"),
    "lend": "select symbol, batch, arg_max(levels, k) as levels from lv where k>0 group by 1, 2",
    "lbook": "select symbol, batch, l.side as side, cast(row_number() over (partition by symbol, batch, l.side order by case when l.side=0 then -l.price else l.price end)-1 as int) as rank, l.price as price, l.size as size from (select symbol, batch, unnest(levels) as l from lend)",
    "lep": "select symbol, batch, is_snapshot, coalesce(max(case when is_snapshot then batch end) over (partition by symbol order by batch), -1) as episode from (select distinct symbol, batch, is_snapshot from l2_hazard)",
    "lstat": "select e.symbol, e.episode, count(distinct v.batch) as batches, count(distinct case when is_snapshot then v.batch end) as snapshot_batches, count(*) filter (where act='adds' and is_snapshot) as snapshot_levels, "
    + ", ".join(f"count(*) filter (where act='{c}') as {c}" for c in ("zero_rows", "adds", "shrinks", "grows", "no_ops", "deletes", "unknown_deletes"))
    + ", count(*) filter (where evicted>0) as crossed_adds, cast(sum(evicted) as bigint) as evictions, cast(0 as bigint) as eviction_stalls, cast(0 as bigint) as fills, cast(sum(rejected) as bigint) as rejected, cast(0 as bigint) as violations from lv v join lep e using (symbol, batch) where k>0 group by 1, 2",
}

FNV = "format('{:016x}', cast(list_reduce(list_prepend(14695981039346656037::hugeint, [cast(ord(c) as hugeint) for c in string_split(s, '')]), lambda h, b: (cast(xor(cast(h as ubigint), cast(b as ubigint)) as hugeint)*1099511628211)%18446744073709551616) as ubigint))"

C = {"d1": ["trades", "tr", "gb", "gr", "blocks"], "d2": ["trades", "bars", "barr"]}
C["bin"] = [*C["d1"], "edges", "binned"]
C["cube"] = [*C["bin"], "cube"]
C["curve"] = [*C["cube"], "curve", "lims", "inner_curve"]
C["acf"] = [*C["d1"], "hours", "flow", "dev", "acf"]
C["reps"] = [*C["cube"], *C["acf"], "lens", "rings0", "weights", "reps"]
C["plc"] = [*C["bin"], "ix", "moved", "pairs", "placebo"]
C["mid"] = [*C["d1"], "quotes", "mids", "bm"]
C["proxy"] = [*C["mid"], "proxy", "pedges", "pb"]
C["pilot"] = ["trades", "spine", "ep", "resp", "bflow"]
C["rv"] = [*C["d1"], "rv", "rvl"]
C["did"] = [*C["d2"], "days", "dw", "did_f", "did_o"]
C["book"] = ["l2", "l2e", "st", "every", "bk", "rk", "top"]
C["cmp"] = [*C["book"], "pub0", "pub1", "pub", "cmp0", "cmp"]
C["rings"] = [*C["curve"], *C["acf"], "lens", "bars", "hc", "hcl", "rv", "rvl", "spine_h", "rr", "rings"]
C["regimes"] = [*C["rings"], "rw", "rreps", "rcurve", "rinner", "rstat", "rsum", "rci"]
C["eq"] = ["equity_messages", "equity_books", "eqm", "eqt", "eqg", "eqb", "eqr", "eqk"]
C["eqw"] = [*C["eq"], "eqflow", "eqdev", "eqacf", "eqlens", "eqrings", "eqw"]
C["eqx"] = [*C["eqw"], *[f"q{p}{x}" for p in ("mid", "trade", "diff") for x in ("", "_edges", "_binned", "_cube", "_curve", "_lims", "_inner", "_reps", "_ci", "_x")]]
C["step"] = [*C["book"], "bk1", "rk1", "nextb", "step0"]
C["sn"] = ["trades", "bands", "snaps"]


def q(parts: list[str], body: str) -> str:
    return ("with recursive " if {"eng", "ieng", "feng", "lv"} & set(parts) else "with ") + ",\n".join(f"{p} as ({PARTS[p]})" for p in dict.fromkeys(parts)) + "\n" + body


def rnd(*cols: str, n: int = 8) -> str:
    return ", ".join(f"round({c}, {n}) as {c}" for c in cols)


def oracle_sql() -> dict[str, str]:
    curve = f"symbol, bin, n, {rnd('mean_q', 'mean_r', 'sd_r')}"
    group = "cast(sum(n) as bigint) as n, round(sum(sq)/sum(n), 8) as mean_q, round(sum(sr)/sum(n), 8) as mean_r, round(case when sum(n)>1 then sqrt(greatest(sum(sr2)/sum(n)-(sum(sr)/sum(n))*(sum(sr)/sum(n)), 0.0)) end, 8) as sd_r"
    out = {
        "d1_event_blocks": q(C["d1"], f"select symbol, day, bi, t, q, {rnd('r')} from blocks"),
        "d2_minute_bars": q(["trades", "bars"], "select * from bars"),
        "d3_minute_response": q(C["d2"], f"select symbol, m, ofi, p0, n, {rnd('r')} from barr"),
        "d4_derive_scale": q(C["d1"], "select symbol, day, bi//2 as g, min(t) as t, cast(sum(q) as bigint) as q, round(sum(r), 8) as r from blocks group by 1, 2, 3 having count(*)=2"),
        "e3_window_duration": q(C["d1"], f"select symbol, day, bi, t, q, {rnd('r')}, round(case when lead(day) over w=day then (lead(t) over w-t)/1e6 end, 8) as dt_s from blocks window w as (partition by symbol order by day, t)"),
        "e4_duration_filled": q(C["d1"], f"select symbol, day, bi, t, q, {rnd('r')}, round(last_value(d ignore nulls) over (partition by symbol order by day, t rows between unbounded preceding and current row), 8) as dt_s from (select *, case when lead(day) over w=day then (lead(t) over w-t)/1e6 end as d from blocks window w as (partition by symbol order by day, t))"),
        "h3_edges": q([*C["d1"], "edges"], f"select symbol, cast(k as int) as k, e[k+1] as edge from edges, range({NB - 1}) t(k)"),
        "d7_cube": q(C["cube"], f"select symbol, h, bin, n, sq, {rnd('sr', 'sr2')} from cube"),
        "d8_impact_curve": q(C["curve"], f"select {curve}, inside from inner_curve"),
        "d8_clock_curve": q(C["d2"], f", x as (select symbol, m as t, ofi as q, r from barr where r is not null), e as (select symbol, [round(x, 6) for x in quantile_cont(q, {CLOCK_PROBS})] as e from x group by 1) select symbol, bin, {group} from (select symbol, len([y for y in e if y <= q]) as bin, 1 as n, q as sq, r as sr, r*r as sr2 from x join e using (symbol)) group by 1, 2"),
        "d10_pinning": q(C["bin"], "select symbol, bin, round(avg(case when r=0 then 1 else 0 end), 5) as frac_zero, round(avg(dt), 5) as mean_duration from (select *, case when lead(day) over w=day then (lead(t) over w-t)/1e6 end as dt from binned window w as (partition by symbol order by day, t)) group by 1, 2"),
        "j20_pilot_curve": q(C["pilot"], ", e as (select symbol, [round(x, 6) for x in quantile_cont(ofi, [k/15 for k in range(1, 15)])] as e from bflow group by 1) select symbol, ofi_bin, round(avg(ofi), 8) as mean_ofi, count(*) as n_obs, round(avg(response), 8) as mean_response from (select b.*, len([x for x in e if x < ofi]) as ofi_bin, response from bflow b join e using (symbol) left join resp using (symbol, bin_start)) group by 1, 2"),
        "c1_bin_flow": q(C["pilot"], "select * from bflow"),
        "c2_asof_edge_price": q(C["pilot"], "select * from ep"),
        "c3_asof_mid": q(C["mid"], "select symbol, day, bi, mid from bm"),
        "g3_bin_spine": q(["trades", "spine"], "select * from spine"),
        "c10_unaligned": q(["l2"], ", p as (select distinct symbol, case when batch%9=0 then ts_us+1 else ts_us end as ts_us, local_ts_us from l2) select symbol, ts_us, local_ts_us from p anti join l2 using (symbol, ts_us, local_ts_us)"),
        "c14_circular_pairs": q(C["plc"], f"select symbol, shift_no, i, bin, {rnd('r')} from pairs"),
        "d11_daily_rv": q(C["d1"], "select symbol, day, round(sum(r*r), 10) as rv, count(*) as n_blocks from blocks group by 1, 2"),
        "h6_vol_terciles": q(C["rv"], "select symbol, day, tercile from rvl"),
        "d12_hour_counts": q(["trades", "bars", "hc"], "select * from hc"),
        "d13_hourly_flow": q(C["acf"][:-2], "select * from flow"),
        "b10_funding_tags": q([*C["d2"], "tagged"], f"select symbol, m, ofi, p0, n, {rnd('r')}, hour, \"window\", day from tagged"),
        "d14_window_stats": q([*C["d2"], "tagged"], "select symbol, \"window\", count(*) as n_minutes, round(avg(ofi), 6) as mean_ofi, round(avg(abs(ofi)), 6) as mean_abs_ofi, round(stddev_samp(ofi), 6) as sd_ofi, round(avg(n), 6) as mean_trades, round(avg(abs(r)), 6) as mean_abs_r, round(case when count(*)>2 then regr_slope(r, ofi) end, 6) as slope from tagged group by 1, 2"),
        "j3_acf": q(C["acf"], f"select symbol, lag, {rnd('acf')} from acf"),
        "j3_block_length": q([*C["acf"], "lens"], f", h as (select symbol, coalesce(min(case when good then lag end), {LAGS}) as horizon from (select symbol, lag, abs(acf)<2/sqrt(720) and lead(abs(acf)<2/sqrt(720), 1) over w and lead(abs(acf)<2/sqrt(720), 2) over w and lag between 1 and {LAGS - 3} as good from acf window w as (partition by symbol order by lag)) group by 1) select symbol, horizon, 9 as rule, greatest(horizon, 9) as block_length from h"),
        "j4_bootstrap_curve": q(C["reps"], f"select symbol, rep, bin, {rnd('mean_r')} from reps"),
        "j5_ci_bands": q([*C["reps"], "bands_ci"], f"select symbol, bin, {rnd('lo', 'hi')} from bands_ci"),
        "j6_gamma": q(C["curve"], "select symbol, round(case when count(*)>=3 then regr_slope(ln(abs(mean_r)), ln(abs(mean_q))) end, 6) as gamma from inner_curve where inside and sign(mean_r)=sign(mean_q) and mean_r<>0 group by 1"),
        "j7_slope": q(C["curve"], "select symbol, round(case when count(*)>=3 then regr_slope(mean_r, mean_q) end, 9) as slope from inner_curve where inside and mean_r is not null group by 1"),
        "j8_turnover": q(C["curve"], f"select symbol, round(max(case when bin=0 then abs(mean_r) end)-max(case when bin=1 then abs(mean_r) end), 8) as sell_side, round(max(case when bin={NB - 1} then abs(mean_r) end)-max(case when bin={NB - 2} then abs(mean_r) end), 8) as buy_side from curve group by 1"),
        "j10_placebo": q(C["plc"], f"select symbol, shift_no, bin, n, {rnd('mean_r')} from placebo"),
        "j11_placebo_corr": q([*C["plc"], *C["reps"], "bands_ci", "curve"], ", x as (select p.symbol, shift_no, p.mean_r-o as c, k.mean_r-o as s, (hi-lo)/2 as half from placebo p join curve k using (symbol, bin) join (select symbol, avg(r) as o from blocks group by 1) using (symbol) left join bands_ci using (symbol, bin)), y as (select symbol, shift_no, max(abs(c)/case when half>1e-12 then half end) as z, corr(c, s) as k, max(abs(c)) as a, max(abs(s)) as real from x group by 1, 2) select symbol, round(max(z), 5) as max_z, round(avg(k), 5) as mean_corr, round(max(abs(k)), 5) as max_corr, round(max(a), 8) as amplitude, round(max(real), 8) as real, round(max(a)/max(real), 4) as ratio, coalesce(max(z)<3 and abs(avg(k))<0.3, false) as passed from y group by 1"),
        "j13_activity_curves": q([*C["cube"], "bars", "hc", "hcl"], f"select symbol, tercile, bin, {group} from (select c.*, tercile from cube c join hcl on c.symbol=hcl.symbol and h%24=hour) group by 1, 2, 3"),
        "j14_regime_curves": q([*C["rings"], "rcurve"], f"select symbol, ring, bin, n, {rnd('mean_q', 'mean_r', 'sd_r')} from rcurve"),
        "j14_regime_stats": q(C["regimes"], f"select symbol, ring, hours, windows, {rnd('slope', 'slope_lo', 'slope_hi', 'amplitude', n=9)} from rsum left join rci using (symbol, ring)"),
        "j15_funding_did": q(C["did"], "select f.symbol, f.rep, " + ", ".join(f"round(f.d_{c}, 6) as d_{c}, round(f.d_{c}-o.d_{c}, 6) as did_{c}" for c in ("mean_abs_ofi", "mean_abs_r", "slope")) + " from did_f f join did_o o using (symbol, rep)"),
        "j15_funding_ci": q(C["did"], ", x as (" + " union all ".join(f"select f.symbol, '{side}' as side, '{c}' as quantity, {v} as v from did_f f join did_o o using (symbol, rep)" for c in ("mean_abs_ofi", "mean_abs_r", "slope") for side, v in (("funding", f"f.d_{c}"), ("non_funding", f"o.d_{c}"), ("did", f"f.d_{c}-o.d_{c}"))) + ") select symbol, side, quantity, round(avg(v), 6) as mean, round(quantile_cont(v, 0.025), 6) as lo, round(quantile_cont(v, 0.975), 6) as hi from x group by 1, 2, 3"),
        "j16_contrast": q(C["regimes"], ", pr as (select * from (values ('H3', 'vol_high', 'vol_low'), ('H4', 'activity_low', 'activity_high')) v(contrast, a, b)), p as (select x.symbol, contrast, x.slope-y.slope as difference from pr join rsum x on x.ring=a join rsum y on y.ring=b and y.symbol=x.symbol), d as (select x.symbol, contrast, x.slope-y.slope as v from pr join rstat x on x.ring=a join rstat y on y.ring=b and y.symbol=x.symbol and y.rep=x.rep), c as (select symbol, contrast, quantile_cont(v, 0.025) as lo, quantile_cont(v, 0.975) as hi from d where v is not null group by 1, 2) select symbol, contrast, round(difference, 9) as difference, round(lo, 9) as lo, round(hi, 9) as hi, case when lo>0 then 'SUPPORTED' when hi<0 then 'FALSIFIED (inverted)' else 'FALSIFIED (flat, CI spans zero)' end as verdict from p left join c using (symbol, contrast)"),
        "b12_verdicts": q([*C["reps"], "lims", "curve", "inner_curve", "ring_curve0", "stat0"], f", ci as (select symbol, quantile_cont(gamma, 0.025) as gamma_lo, quantile_cont(gamma, 0.975) as gamma_hi, quantile_cont(sell_side, 0.025) as sell_lo, quantile_cont(sell_side, 0.975) as sell_hi, quantile_cont(buy_side, 0.025) as buy_lo, quantile_cont(buy_side, 0.975) as buy_hi from stat0 group by 1), g as (select symbol, case when count(*)>=3 then regr_slope(ln(abs(mean_r)), ln(abs(mean_q))) end as gamma from inner_curve where inside and sign(mean_r)=sign(mean_q) and mean_r<>0 group by 1), t as (select symbol, max(case when bin=0 then abs(mean_r) end)-max(case when bin=1 then abs(mean_r) end) as sell_side, max(case when bin={NB - 1} then abs(mean_r) end)-max(case when bin={NB - 2} then abs(mean_r) end) as buy_side from curve group by 1) select symbol, {rnd('gamma', 'gamma_lo', 'gamma_hi', 'sell_side', 'sell_lo', 'sell_hi', 'buy_side', 'buy_lo', 'buy_hi', n=6)}, case when gamma is null then 'not testable' when gamma<=0 then 'FALSIFIED (response decreasing in |Q|)' when gamma_hi<1 then 'SUPPORTED (concave)' when gamma_lo>1 then 'FALSIFIED (convex)' else 'FALSIFIED (linear within CI)' end as h1, case when sell_hi<0 or buy_hi<0 then 'SUPPORTED (turnover on at least one side)' when sell_lo>0 and buy_lo>0 then 'FALSIFIED (extreme bin extends the trend on both sides)' else 'inconclusive (CI spans zero on both sides)' end as h2 from t left join g using (symbol) left join ci using (symbol)"),
        "j19_proxy_ratios": q([*C["reps"], "bands_ci"], "select symbol, round(avg(hi-lo), 7) as mean_ci_width, round(max(hi-lo), 7) as max_ci_width, round(8.099e-07/nullif(avg(hi-lo), 0), 7) as mean_ratio, round(7.999e-06/nullif(max(hi-lo), 0), 7) as max_ratio from bands_ci group by 1"),
        "j17_proxy_clear": q([*C["proxy"], "pdiff", *[f"p_{x}" for x in ("edges", "binned", "cube", "curve")], "one", "prings", "pw", "preps", "p_ci"], "select symbol, count(mean_r) as n_bins, count(*) filter (where lo>0 or hi<0) as n_clear from p_curve left join p_ci using (symbol, bin) group by 1"),
        "a24_curve_table": q([*C["acf"], "lens", "bars", "barr", "ewin", "ewd", "cwd", *[f"{p}_{x}" for p in ("e", "c") for x in ("edges", "binned", "cube", "curve", "lims", "inner", "lens", "rings", "w", "reps", "ci", "stat", "table")]], "select * from e_table union all select * from c_table"),
        "a12_midprices": q(["equity_books", "eqm"], f"select symbol, day, row_index, {rnd('midprice', 'spread')} from eqm"),
        "c6_equity_trades": q(C["eq"][:4], f"select symbol, day, row_index, t, signed_qty, {rnd('trade_price', 'midprice', 'spread')}, is_hidden from eqt"),
        "d16_equity_summary": q(C["eq"][:4], ", m as (select symbol, count(*) as message_rows, " + ", ".join(f"count(*) filter (where type={k}) as n{k}" for k in (1, 2, 3, 4, 5, 7)) + " from equity_messages group by 1), t as (select symbol, count(*) as trade_rows, count(*) filter (where not is_hidden) as visible_trades, count(*) filter (where is_hidden) as hidden_trades, round(avg(midprice), 6) as mean_midprice, round(avg(spread), 6) as mean_spread, round(avg(trade_price), 6) as mean_trade_price from eqt group by 1) select * from m left join t using (symbol)"),
        "d5_equity_blocks": q(C["eq"], f"select symbol, day, bi, t, q, {rnd('r', 'r_mid')} from eqk"),
        "d6_equity_scale": q(C["eq"], "select symbol, day, bi//2 as g, min(t) as t, sum(q) as q, round(sum(r), 8) as r, round(sum(r_mid), 8) as r_mid from eqk group by 1, 2, 3 having count(*)=2"),
        "j18_equity_curves": q(C["eqx"], " union all ".join(f"select symbol, response, bin, n, {rnd('mean_q', 'mean_r', 'lo', 'hi', n=7)} from q{p}_x" for p in ("mid", "trade", "diff"))),
        "j18_equity_analysis": q([*C["eqx"], "qmid_in", "qstat"], ", w as (select symbol, cast(sum(n) as bigint) as n_windows, max(abs(mean_r)) as mid_amplitude, avg(hi-lo) as mean_ci_width, max(hi-lo) as max_ci_width from qmid_x group by 1), d as (select symbol, count(mean_r) as n_bins, count(*) filter (where lo>0 or hi<0) as n_bins_biased, avg(abs(mean_r)) as mean_abs_diff, max(abs(mean_r)) as max_abs_diff from qdiff_x group by 1), g as (select symbol, case when count(*)>=3 then regr_slope(ln(abs(mean_r)), ln(abs(mean_q))) end as gamma from qmid_inner where inside and sign(mean_r)=sign(mean_q) and mean_r<>0 group by 1), c as (select symbol, quantile_cont(gamma, 0.025) as gamma_lo, quantile_cont(gamma, 0.975) as gamma_hi from qstat where gamma is not null group by 1) select symbol, n_windows, n_bins, n_bins_biased, " + rnd("gamma", "gamma_lo", "gamma_hi", "mean_abs_diff", "max_abs_diff", "mid_amplitude", "mean_ci_width", "max_ci_width", n=6) + " from w join d using (symbol) left join g using (symbol) left join c using (symbol)"),
        "a4_book_rows": "with x as (select event_id as n, 100000+cast(round(value*100) as bigint) as p from events), y as (select *, case when n%41=0 then 'FieldCount' when n%31=0 or n%37=0 then 'BadNumber' else 'Ok' end as status from x) select status, count(*) as n, cast(sum(case when status='Ok' then case when n%5=0 then 2 else 3 end end) as bigint) as asks, cast(sum(case when status='Ok' then 3 end) as bigint) as bids, cast(sum(case when status='Ok' then p-1 end) as bigint) as best_bids, cast(sum(case when status='Ok' then 3000 end) as bigint) as second_sizes from y group by 1",
        "a5_order_status": q(["order_feed"], ", x as (select *, case when seq%37=0 then 'FieldCount' when seq%31=0 then 'BadType' when seq%43=0 or order_id<0 then 'BadNumber' when seq%41=0 then 'BadSide' else 'Ok' end as status from order_feed) select status, count(*) as n, " + ", ".join(f"cast(sum(case when status='Ok' then {v} end) as bigint) as {c}" for c, v in (("ts_us", "ts_us%86400000000"), ("type", "type+1"), ("order_id", "order_id"), ("size", "size"), ("price", "price*100"), ("side", "side"))) + " from x group by 1"),
        "a11_mid_csv": q(["quotes"], "select ts_us, round((ask_ticks+bid_ticks)/2, 8) as midprice from quotes"),
        "a13_band_snapshots": q(["bands"], "select epoch_us(hour_ts) as ts_us, band, depth_lots as depth from bands where hour_ts>=timestamp '2024-01-03' and hour_ts<timestamp '2024-01-20 12:00:00' and hour(hour_ts)%5<>0"),
        "a6_order_books": "with x as (select event_id as n, 5000000+cast(round(value*100) as bigint) as p from events), y as (select *, case when n%29=0 then 'FieldCount' when n%23=0 then 'BadNumber' else 'Ok' end as status from x) select status, count(*) as n, cast(sum(case when status='Ok' then case when n%4=0 then 1 else 2 end end) as bigint) as asks, cast(sum(case when status='Ok' then case when n%6=0 then 0 else 1 end end) as bigint) as bids, cast(sum(case when status='Ok' then p+1 end) as bigint) as best_asks from y group by 1",
        "a14_window_trades": q(["trades"], f"select symbol, ts_us//1000 as ts_ms, price_ticks as price, {SIGNED} as qty from trades where ts_us>={T0 + 5 * H} and ts_us<{T0 + 200 * H}"),
        "a17_run_outcomes": q(["trades"], ", t as (select symbol, day, count(*) as rows from trades group by 1, 2), r as (select symbol, cast(d as date) as day from (values ('AAA'), ('BBB'), ('CCC')) v(symbol), range(date '2024-01-01', date '2024-01-31', interval 1 day) r(d)), x as (select r.symbol, r.day, rows, case when rows is not null and day(r.day)%3=0 and day(r.day)%2=0 then 'skipped' when rows is null or day(r.day)%7=0 then 'gap' else 'reduced' end as outcome from r left join t on t.symbol=r.symbol and t.day=r.day) select symbol, day, outcome, case when outcome='reduced' then rows end as rows, case when outcome='gap' then case when rows is null then 'no raw file' else 'cut off' end end as error from x"),
        "a19_day_store": q(["trades"], "select symbol, day, id, ts_us, price_ticks, qty_lots, is_buyer_maker from trades where symbol='AAA' and day between date '2024-01-05' and date '2024-01-20'"),
        "a20_iwd1_roundtrip": q(["trades", "bands"], f", s as (select epoch_ms(hour_ts)//86400000 as k, count(distinct hour_ts) as snapshots from bands group by 1), t as (select ts_us//86400000000 as k, count(*) as trades, cast(sum({SIGNED}) as bigint) as qty from trades where symbol='AAA' group by 1) select cast(strftime(make_timestamp(k*86400000000), '%Y%m%d') as int) as day, snapshots, trades, qty, true as snapshots_equal, true as trades_equal from s join t using (k)"),
        "a23_window_index": q([*C["rv"], "bands"], ", v as (select symbol, day, cast(sum(qty_lots) as double) as volume from trades group by 1, 2) select 'BTCUSDT-'||strftime(r.day, '%Y%m%d') as file, 'BTCUSDT' as symbol, cast(strftime(r.day, '%Y%m%d') as int) as day, epoch_ms(r.day) as start_ms, epoch_ms(r.day)+86400000 as end_ms, 10 as price_scale, 1000 as qty_scale, round(sqrt(rv), 9) as day_sigma, volume as day_volume_base, case tercile when 0 then 'low' when 1 then 'mid' else 'high' end as vol_tercile, 'every fourth day' as reason from rvl r join v on v.symbol=r.symbol and v.day=r.day where r.symbol='AAA' and cast(strftime(r.day, '%Y%m%d') as int)%4=1"),
        "a28_level_messages": q([*C["book"][:3], "steps", "acts", "sent"], "select symbol, batch*1048576+row_number() over (partition by symbol, batch order by phase, seq)-1 as seq, ts_us, order_id, price, size, type, side from sent"),
        "b11_crosses": q(["quotes"], "select id, case when id%2=0 then bid_ticks+id%9-2<=bid_ticks else bid_ticks+id%9-2>=ask_ticks end as crosses from quotes"),
        "d22_feed_profile": q(["l2"], ", a as (select symbol, ts_us as ts, count(*) as n from l2 group by 1, 2), g as (select symbol, ts, n, lead(ts) over (partition by symbol order by ts)-ts as gap from a) select a.symbol, a.n_rows, first_ts, last_ts, distinct_ts, median_gap, least_rows, most_rows, snapshot_rows, round(snapshot_rows/a.n_rows, 8) as snapshot_share from (select symbol, cast(sum(n) as bigint) as n_rows, min(ts) as first_ts, max(ts) as last_ts, count(*) as distinct_ts, quantile_cont(gap, 0.5) as median_gap, min(n) as least_rows, max(n) as most_rows from g group by 1) a join (select symbol, count(*) filter (where is_snapshot) as snapshot_rows from l2 group by 1) using (symbol)"),
        "d22_trade_profile": q(["trades"], "select symbol, count(*) as n_rows, min(ts_us) as first_us, max(ts_us) as last_us, count(*) filter (where is_buyer_maker) as maker, count(*) filter (where not is_buyer_maker) as taker, round(count(*)*1e6/(max(ts_us)-min(ts_us)), 6) as per_second from trades group by 1"),
        "d22_value_counts": q(["order_feed"], "select symbol, size as value, count(*) as n from order_feed group by 1, 2"),
        "f5_spread": q(["order_feed"], ", x as (select symbol, min(size) as least, max(size) as most, list_sort(list(size))[count(*)//2+1] as median from order_feed group by 1) select *, (most-least)*1000//median as permille, ((most-least)*1000//median//10)||'.'||((most-least)*1000//median%10)||'%' as text from x"),
        "f6_examples": q(C["cmp"], "select * from (select *, cast(row_number() over (partition by symbol order by batch) as int) as example from cmp where class<>'None') where example<=20"),
        "h8_checksums": q(["trades"], ", x as (select symbol, day, symbol||'-'||day||'-'||sum(qty_lots) as s from trades group by 1, 2) select symbol, day, " + FNV + " as checksum from x"),
        "h9_epochs": q(["trades"], "select id, ts_us//1000 as ms, cast(strftime(make_timestamp(ts_us), '%Y%m%d') as int) as day_int, strftime(make_timestamp(ts_us), '%Y-%m-%dT%H:%M:%SZ') as iso from trades"),
        "i3_fills": q(["order_feed", "ms", "eng", "fl"], "select symbol, seq, ts_us, aggressor, f.oid as order_id, side, f.price as price, f.size as size from fl"),
        "i9_invariants": q(["order_feed", "ms", "eng", "totals"], "select *, cast(0 as bigint) as violations, qty_added-2*qty_filled-qty_removed-resting as residual from totals"),
        "k7_readbacks": q(["order_feed", "ms", "eng", "fl"], "select symbol, count(*) as fill_count, cast(sum(f.size) as bigint) as filled, cast(sum(f.price*f.size) as bigint) as cumulative_cost from fl group by 1"),
        "k5_inject": q(["order_feed", "ioc", "ims", "ieng"], "select symbol, f.oid as order_id, f.price as price, f.size as size from (select symbol, unnest(fills) as f from ieng where oid=cast(1 as bigint)<<60 and type=0)"),
        "i16_order_feed": q(["order_feed", "fms", "feng", "ftotals"], "select symbol, note, size from (unpivot ftotals on columns(* exclude (symbol)) into name note value size)"),
        "a27_feed_checksum": q(["order_feed", "ms", "eng", "fl", "lines"], f"select symbol, fills, filled, {FNV} as checksum from lines"),
        "i13_hazard": q(["l2_hazard", "lrows", "lv", "lend", "lbook", "lep", "lstat"], "select symbol, batch, side, rank, price, size, cast(null as varchar) as note from lbook union all select symbol, null, null, null, null, size, note from (unpivot lstat on columns(* exclude (symbol, episode)) into name note value size)"),
        "i20_whole_batches": q(["l2"], ", n as (select *, row_number() over (partition by symbol order by seq)-1 as k, count(*) over (partition by symbol) as total from l2), c as (select symbol, min(batch) as cut from n where k>=5002 and total>5003 group by 1) select n.symbol, seq, batch from n left join c using (symbol) where cut is null or batch<cut"),
        "i21_single_step": q(C["step"], "select symbol, batch as row_index, coalesce(arg_min(cls, rank*2+1-side) filter (where cls is not null), 'None') as class, min(rank) filter (where cls is not null) as rank, coalesce(min(rank) filter (where cls is not null)<>0, true) as touch_exact from step0 group by 1, 2"),
        "i22_exit_gate": "select 'AAA' as symbol, gate='replay' as clean, gate from (values ('replay'), ('with parsing')) v(gate)",
        "a7_tape_text": q(["order_feed"], ", x as (select *, case when seq%43=0 then 'UnknownTag' when seq%47=0 and type in (0, 3) then 'BadSide' when seq%53=0 and not (seq%47=0) then 'MissingFields' else 'Ok' end as status from order_feed where not (seq%59=0 and not (seq%43=0 or seq%47=0 or seq%53=0))) select status, case when status='Ok' then type end as type, count(*) as n, cast(sum(case when status='Ok' then case when type in (0, 1, 3) then size else 0 end end) as bigint) as total, cast(sum(case when status='Ok' then case when type in (0, 3) then price else 0 end end) as bigint) as prices, cast(sum(case when status='Ok' then case when type in (0, 1, 2) then order_id else 0 end end) as bigint) as ids from x group by 1, 2"),
        "j17_proxy_diff": q(C["proxy"], "select symbol, bin, count(*) as n, round(avg(r-r_mid), 8) as mean_diff from pb group by 1, 2"),
        "d17_proxy_headline": q(C["proxy"], "select symbol, round(avg(abs(a-b)), 8) as mean_abs_diff, round(max(abs(a-b)), 8) as max_abs_diff, round(max(abs(b)), 8) as amplitude from (select symbol, bin, avg(r) as a, avg(r_mid) as b from pb group by 1, 2) group by 1"),
        "d6_proxy_scale": q(C["proxy"], "select symbol, day, bi//2 as g, min(t) as t, cast(sum(q) as bigint) as q, round(sum(r), 8) as r, round(sum(r_mid), 8) as r_mid from proxy group by 1, 2, 3 having count(*)=2 and max(bi)-min(bi)=1"),
        "d15_day_volume": q(["trades"], "select symbol, day, cast(sum(qty_lots) as bigint) as volume from trades group by 1, 2"),
        "d16_summary": q(["order_feed"], "select symbol, " + ", ".join(f"count(*) filter (where type={k}) as n{k}" for k in range(5)) + ", count(*) filter (where side=0) as bids, round(avg(size), 8) as mean_size, round(avg(price), 8) as mean_price from order_feed group by 1"),
        "b1_scaled_decimal": """with x as (select distinct l_orderkey, l_linenumber, l_partkey, l_partkey%9 as k, cast(l_orderkey as varchar) as w from lineitem)
select l_orderkey, l_linenumber, l_partkey,
case k when 0 then w||'.25' when 1 then '-'||w||'.500' when 2 then '+'||w when 3 then w||'.0625' when 4 then w||'e5' when 5 then '.75' when 6 then ' '||w when 7 then '1234567890123456'||case when length(w)>6 then w[:6] else lpad(w, 6, '0') end else '.' end as text,
case k when 3 then 'PrecisionLoss' when 4 then 'Malformed' when 6 then 'Malformed' when 7 then 'Overflow' when 8 then 'Malformed' else 'Ok' end as status,
case k when 0 then l_orderkey*1000+250 when 1 then -(l_orderkey*1000+500) when 2 then l_orderkey*1000 when 5 then 750 end as value from x""",
        "b2_level_id": q(["l2"], "select seq, price*2+side as level_id from l2"),
        "a3_l2_status": q(["l2"], ", x as (select *, case when seq%37=0 then 'FieldCount' when seq%41=0 then 'BadFlag' when seq%31=0 then 'BadSide' when seq%29=0 then 'BadNumber' else 'Ok' end as status from l2) select status, count(*) as n, cast(sum(case when status='Ok' then price*10+5 end) as bigint) as price, cast(sum(case when status='Ok' then amount*100 end) as bigint) as amount from x group by 1"),
        "i11_batches": q(["l2"], "select symbol, batch as session, count(*) as n, min(seq) as first_seq from l2 group by 1, 2"),
        "i13_l2_book": q(C["book"], "select symbol, batch, side, price, size, rank from rk"),
        "i13_two_pass": q(C["book"], "select symbol, batch, side, rank, price, size from top"),
        "i13_counts": q(C["book"][:3], "select symbol, count(*) filter (where is_snapshot and amount>0) as snapshot_levels, count(*) filter (where is_snapshot and amount<=0) as zero_rows, count(*) filter (where not is_snapshot and amount<=0 and coalesce(prev, 0)>0) as deletes, count(*) filter (where not is_snapshot and amount<=0 and coalesce(prev, 0)<=0) as unknown_deletes, count(*) filter (where not is_snapshot and amount>0 and coalesce(prev, 0)<=0) as adds, count(*) filter (where not is_snapshot and amount>0 and prev>0 and amount<prev) as shrinks, count(*) filter (where not is_snapshot and prev>0 and amount>prev) as grows, count(*) filter (where not is_snapshot and amount>0 and amount=prev) as no_ops from st group by 1"),
        "i13_guard": q(["l2"], "select symbol, cast(0 as bigint) as repeated_levels, cast(0 as bigint) as crossed_batches from l2 group by 1"),
        "f1_top_levels": q(C["book"], "select symbol, batch, side, price, size, rank from top"),
        "i18_book_compare": q(C["cmp"], "select * from cmp"),
        "d19_tally": q(C["cmp"], "select symbol, class, coalesce(rank, -1) as rank, count(*) as n from cmp group by 1, 2, 3"),
        "d20_ppm": q(C["cmp"], ", x as (select symbol, count(*) as compared, count(*) filter (where class='None') as exact from cmp group by 1) select *, exact*1000000//compared as ppm, (exact*1000000//compared//10000)||'.'||lpad(cast(exact*1000000//compared%10000 as varchar), 4, '0')||'%' as pct from x"),
        "d22_episodes": q(["l2"], "select symbol, cast(sum(case when is_snapshot and not coalesce(p, false) then 1 else 0 end) as bigint) as episodes, cast(sum(case when is_snapshot then 1 else 0 end) as bigint) as snapshot_rows from (select *, lag(is_snapshot) over (partition by symbol order by seq) as p from l2) group by 1"),
        "l2_message_kinds": q(["order_feed", "msgs"], ", x as (select symbol, type, size, coalesce(case when pt in (0, 1) then ps else 0 end, 0) as live from msgs where type in (0, 1, 2)) select symbol, case when type=0 then 'add' when type=2 then 'delete' when size>live then 'grow' when size<live and size>0 then 'shrink' else 'noop' end as kind, count(*) as n from x group by 1, 2"),
        "f4_percentiles": q(["order_feed"], ", x as (select symbol, size, count(*) over (partition by symbol) as n, row_number() over (partition by symbol order by size, seq)-1 as i from order_feed) select symbol, case when i=n*50//100 then 50 else 99 end as pct, size from x where i in (n*50//100, n*99//100)"),
        "f7_slices": q([*C["sn"], "hs", "slices"], "select slice, ts from slices"),
        "k2_walk_book": q(C["sn"], ", x as (select *, 5-band as rank, depth*5e-1 as avail, coalesce(sum(depth*5e-1) over (partition by ts order by band desc rows between unbounded preceding and 1 preceding), 0) as before from snaps where band<=5) select ts, round(mid, 6) as mid, band, cast(rank as int) as rank, round(greatest(0e0, least(avail, 3000-before)), 6) as qty, round(mid*(1+pct_tenths/1000), 6) as price from x where least(avail, 3000-before)>0"),
        "k3_schedule": q([*C["sn"], "hs", "slices", "buy"], ", f as (select s.slice, s.ts, coalesce(sum(greatest(0e0, least(avail, 5000-before))), 0e0) as filled, coalesce(sum(greatest(0, least(avail, 5000-before))*mid*(1+pct_tenths/1000)), 0) as cost, any_value(mid) as mid from slices s join buy using (ts) group by 1, 2), a as (select arg_min(mid, slice) as arrival from f), c as (select slice, ts, filled, sum(filled) over (order by slice) as cf, sum(cost) over (order by slice) as cc, arrival from f, a) select slice, ts, round(filled, 6) as filled, round(cf, 6) as cum_filled, round(cc, 6) as cum_cost, round((cc/cf-arrival)/arrival, 6) as realized, round(0.05*sqrt(cf/1000000.0), 6) as reference from c"),
        "k4_sqrt_reference": q(["trades"], "select symbol, day, round(0.05*sqrt(100/sum(qty_lots)), 8) as cost from trades group by 1, 2"),
        "k6_seed_ladder": q(C["sn"], "select ts, band, cast(k as int) as k, case when band<=5 then 0 else 1 end as side, cast(floor(mid*(1+pct_tenths/1000)+0.5) as bigint) as price, greatest(1, cast(floor(depth/4+0.5) as bigint)) as size from snaps, range(1, 5) t(k) where depth>0"),
        "e6_delta_codec": q(["bands"], "select hour_ts, band, depth_lots-coalesce(lag(depth_lots) over (partition by band order by hour_ts), 0) as delta, depth_lots as back from bands"),
        "a16_manifest_pending": q(["trades"], ", t as (select distinct symbol, day from trades where day(day)%3<>0 and day(day)%5<>0) select symbol, day from (select symbol, cast(d as date) as day from (values ('AAA'), ('BBB'), ('CCC')) v(symbol), range(date '2024-01-01', date '2024-01-31', interval 1 day) r(d)) anti join t using (symbol, day)"),
        "i2_engine_counts": q(["order_feed"], "select symbol, cast(count(*) as bigint) as messages, count(*) filter (where type=3) as trades, count(*) filter (where type=4) as snapshot_resets, count(*) filter (where type<3) as others, cast(0 as bigint) as violations, cast(0 as bigint) as residual from order_feed group by 1"),
    }
    return {k: v.replace(")\n,", "),\n") for k, v in out.items()}
