"""SQL for frames of a wave: each function makes the text of CTEs from a table of samples. The tables
carry the key columns `keys`; nothing here runs on Spark."""

from __future__ import annotations

import numpy as np

from ..functions import kernels as K


def spectra(keys: str, size: int, src: str = "f") -> str:
    """f(keys, j, x), frames of `size` samples, to t (tapered by a raised cosine) and p(keys, k, p), the
    power of the transform after as many zeros behind."""
    n = 2 * size
    return f"""t as (select {keys}, j, x * (0.5::double - 0.5::double * cos(2 * pi() * j / {size - 1})) as x from {src}),
trig as (select unnest(range({n})) i), trig2 as (select i, cos(2 * pi() * i / {n}) c, sin(2 * pi() * i / {n}) s from trig), bins as (select unnest(range({size + 1})) k),
p as (select {keys}, k, power(sum(x * c), 2) + power(sum(x * s), 2) as p from t cross join bins join trig2 on trig2.i = (j * k) % {n} group by {keys}, k)"""


def cepstra(keys: str, size: int, rate: float, bands: int = 40, low: float = 500.0, high: float = 4000.0, coefficients: int = 13) -> str:
    """p to bark(keys, band, e) and c(keys, coef, x)."""
    z = lambda f: f"(26.81::double * ({f}) / (1960 + ({f})) - 0.53::double)"
    return f"""edge as (select i, {z(low)} + ({z(high)} - {z(low)}) * i / {bands + 1} as z from (select unnest(range({bands + 2})) i)),
axis as (select k, {z(f'k * {rate / 2}::double / {size}')} as z from bins),
tri as (select x.i as band, k, greatest(0, least((axis.z - x.z) / (y.z - x.z), (w.z - axis.z) / (w.z - y.z))) as w from edge x join edge y on y.i = x.i + 1 join edge w on w.i = x.i + 2 cross join axis),
bank as (select band, k, w / case when sum(w) over (partition by band) > 0 then sum(w) over (partition by band) else 1 end as w from tri),
bark as (select {keys}, band, sum(p * w) as e from p join bank using (k) group by {keys}, band),
coefs as (select unnest(range({coefficients})) coef),
c as (select {keys}, coef, sum(10 * log10(greatest(e, 1e-10::double)) * cos(pi() / {bands} * (band + 0.5::double) * coef) * sqrt(2.0::double / {bands}) * case when coef = 0 then sqrt(0.5::double) else 1 end) as x from bark cross join coefs group by {keys}, coef)"""


def shape(keys: str, size: int, rate: float) -> str:
    """p to d(keys, the six spectral descriptors)."""
    top = f"{rate / 2}::double / {size}"
    on = " and ".join(f"p.{x.strip()} = peak.{x.strip()}" for x in keys.split(","))
    own = ", ".join(f"p.{x.strip()}" for x in keys.split(","))
    return f"""peak as (select {keys}, max(p) mx, arg_min(k, (-p, k)) kk from p group by {keys}),
width as (select {own}, mx, coalesce(max(k) filter (k < kk and p < mx / 2), -1) + 1 as a, coalesce(min(k) filter (k > kk and p < mx / 2), {size + 1}) - 1 as b from p join peak on {on} group by {own}, mx, kk),
strong as (select {keys}, mx / log10((b + 2)::double / (a + 1)) as "StrongPeak" from width),
near as (select *, lag(p) over (partition by {keys} order by k) b, lead(p) over (partition by {keys} order by k) c from p),
d as (select {keys}, sum(p * k * {top}) / nullif(sum(p), 0) as "SpectralCentroid", regr_slope(p, k * {top}) as "SpectralDecrease",
case when avg(p) <= 0 then null when min(p) <= 0 then 1 else greatest(0, least(1, log10(exp(avg(ln(case when p > 0 then p end))) / avg(p)) / -6)) end as "SpectralFlatness",
max(p) / nullif(avg(p), 0) as "SpectralCrest", (count(*) filter (p > b and p >= c and p > 0.005::double))::double as "SpectralComplexity" from near group by {keys})"""


def pitch(keys: str, n: int, rate: float, src: str, low: float = 100.0, high: float = 3000.0, tolerance: float = 0.15) -> str:
    """src(keys, j, x), frames of n samples (later ones, if missing, are zeros), to pitch(keys, hz, sure)."""
    lo, hi, half = max(2, int(rate / high)), min(n // 2, int(np.ceil(rate / low)) + 1), n // 2
    on = " and ".join(f"a.{x.strip()} = b.{x.strip()}" for x in keys.split(","))
    own = ", ".join(f"a.{x.strip()}" for x in keys.split(","))
    w = f"(partition by {keys} order by l)"
    return f"""lags as (select unnest(range({hi + 1})) l), ya as (select * from {src} where j < {half}),
yd as (select {own}, l, sum(power(a.x - coalesce(b.x, 0), 2)) as d from ya a cross join lags left join {src} b on {on} and b.j = a.j + l group by {own}, l),
yc as (select *, sum(case when l > 0 then d else 0 end) over {w} as run, sum(case when l > 0 then d else 0 end) over (partition by {keys}) as total from yd),
yn as (select {keys}, l, total, case when l = 0 then 1 else d * l / greatest(run, 1e-12::double) end as v from yc),
ys as (select *, lag(v) over {w} as a, lead(v) over {w} as c from yn),
y0 as (select {keys}, coalesce(min(l) filter (l >= {lo} and l < {hi} and v < {tolerance}::double), arg_min(l, (v, l)) filter (l >= {lo} and l < {hi})) as k from ys group by {keys}),
y1 as (select ys.*, row_number() over (partition by {', '.join('ys.' + x.strip() for x in keys.split(','))} order by l) as nth from ys join y0 using ({keys}) where l >= k and (l + 1 >= {hi} or c >= v)),
pitch as (select {keys}, case when total > 1e-12::double and v < 1 then {rate}::double / (l + case when l < {hi} and a - 2 * v + c > 0 then 0.5::double * (a - c) / (a - 2 * v + c) else 0 end) else 0 end as hz,
case when total > 1e-12::double and v < 1 then greatest(0, 1 - v) else 0 end as sure from y1 where nth = 1)"""


def impulse(taps: int, rate: int = 44100, name: str = "h") -> str:
    """h(i, h): the impulse response of the equal-loudness filter. Needs `with recursive`."""
    b, a, b2, a2 = K.EQUAL_LOUDNESS[rate]
    b, a = np.convolve(b, b2), np.convolve(a, a2)
    past = ", ".join(f"{-x!r}::double" for x in a[1:].tolist())
    feed = "[" + ", ".join(f"{x!r}::double" for x in b.tolist()) + "]"
    p = len(a) - 1
    step = f"list_dot_product([{past}], y) + case when i + 1 < {len(b)} then {feed}[i + 2] else 0 end"
    return f"""{name}0 as (select 0 as i, [{float(b[0])!r}::double{', 0::double' * (p - 1)}] as y union all select i + 1, list_prepend({step}, y[1:{p - 1}]) from {name}0 where i + 1 < {taps}), {name} as (select i, y[1] as h from {name}0)"""


def eigenvectors(n: int, k: int, src: str = "cov", doublings: int = 13) -> str:
    """cov(i, j, v), symmetric, to e1 ... ek(i, v): unit eigenvectors by descending eigenvalue, the largest
    entry positive; each by repeated squaring of what is left of the matrix."""
    out = [f"m0 as materialized (select i, j, v from {src})"]
    for c in range(1, k + 1):
        last = f"m{c - 1}"
        for s in range(doublings):
            raw, scaled = f"s{c}_{s}r", f"s{c}_{s}"
            out.append(f"{raw} as materialized (select a.i, b.j, sum(a.v * b.v) as v from {last} a join {last} b on a.j = b.i group by a.i, b.j)")
            out.append(f"{scaled} as materialized (select i, j, v / (select sum(v) from {raw} where i = j) as v from {raw})")
            last = scaled
        out.append(f"g{c} as materialized (select i, v from {last} where j = (select arg_max(i, v) from {last} where i = j))")
        out.append(f"e{c} as materialized (select i, v / (select sqrt(sum(v * v)) * sign(arg_max(v, abs(v))) from g{c}) as v from g{c})")
        if c < k:
            value = f"(select sum(a.v * m.v * b.v) from m{c - 1} m join e{c} a on a.i = m.i join e{c} b on b.i = m.j)"
            out.append(f"m{c} as materialized (select m.i, m.j, m.v - {value} * a.v * b.v as v from m{c - 1} m join e{c} a on a.i = m.i join e{c} b on b.i = m.j)")
    return ", ".join(out)
