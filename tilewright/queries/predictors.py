"""Predictors, tile choice and subset search, for every row of ``part`` as a problem, over the links of the trace."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tilewright.plans import links as lk
from tilewright.plans import predict as pr
from tilewright.plans import search as se
from tilewright.plans import tuner as tn
from tilewright.queries.planning import LINK_SQL, LOOKUP_SQL, PROB_SQL, link, lookup, problems
from tilewright.queries.registry import query, r, table

UNITS = [-1, 0, 1, 2, 3]
UNIT_LOOKUP_SQL = "ulook AS (SELECT u::INT AS unit, T, t_s * (1 + u / 4.0::DOUBLE) AS t_s, w + 10 * u AS w FROM lookup, range(4) r(u))"
BASE_SQL = f"{LOOKUP_SQL}, {UNIT_LOOKUP_SQL}, {PROB_SQL}, {LINK_SQL}, sl AS (SELECT dest, src, ti, tb, 1 + (dest + 2) * (src + 3) % 5 / 10.0::DOUBLE AS sl FROM link)"


def model_sql(level: int, locs: str, compat: bool = True) -> str:
    """CTEs up to ``q``: each problem with its tile's time t, whole time full_t, and r and s of one tile at the main location."""
    dims = [f"D{k}" for k in range(1, level + 1)]
    least = f"least({', '.join(dims)})" if level > 1 else "D1"
    big = "256" if level == 1 and compat else f"least(4096, {', '.join(dims)})"
    size = "8 * T * T" if level == 3 else "8 * T"
    count = " + ".join(f"({x} = u)::INT" for x in locs.split(","))
    return f"""{BASE_SQL}, q0 AS (SELECT pid, unit, D1, D2, D3, least(T_in, {least})::BIGINT AS T, loc_a - 1 AS la, loc_b - 1 AS lb, loc_c - 1 AS lc FROM prob),
q1 AS (SELECT q.*, x.t_s * (q.T::DOUBLE / x.T) ** {3 if compat else level} AS tt, z.t_s * {' * '.join(f'({d}::DOUBLE / z.T)' for d in dims)} AS full_t FROM q0 q
 JOIN ulook x ON x.unit = q.unit AND x.T = coalesce((SELECT max(T) FROM lookup WHERE T <= q.T), 256) JOIN ulook z ON z.unit = q.unit AND z.T = coalesce((SELECT max(T) FROM lookup WHERE T <= {big}), 256)),
cand AS (SELECT pid, u, {count} AS n, l.ti + l.tb * ({size}) AS r, k.ti + k.tb * ({size}) AS s, place FROM q1, (VALUES (-1, 0), (0, 1), (1, 2), (2, 3), (3, 4)) c(u, place), link l, link k WHERE l.dest = q1.unit AND l.src = u AND k.dest = u AND k.src = q1.unit),
best AS (SELECT pid, arg_max(u, (n, r, -place)) AS mv, arg_max(r, (n, r, -place)) AS r, arg_max(s, (n, r, -place)) AS s FROM cand GROUP BY pid), q AS (SELECT q1.*, mv, r, s, {size} AS tile_bytes FROM q1 JOIN best USING (pid))"""


def unit_lookup(spark):
    u = F.col("unit")
    return lookup(spark).crossJoin(spark.range(4).select(F.col("id").cast("int").alias("unit"))).select("unit", "T", (F.col("sec") * (1 + u / 4.0)).alias("sec"), (F.col("w") + 10 * u).alias("w"))


def links(spark, sf):
    d, s = F.col("dest"), F.col("src")
    return link(spark, sf).select("dest", "src", "ti", "tb", (1 + (d + 2) * (s + 3) % 5 / 10.0).alias("sl"))


def at_work(spark, sf, level=3, compat=True):
    dims = ["T_in", *(f"D{k}" for k in range(1, level + 1))]
    locs = [(F.col(f"loc_{x}") - 1).alias(f"loc_{x}") for x in "abc"]
    p = problems(spark, sf).select("pid", "unit", "D1", "D2", "D3", F.least(*dims).alias("T"), *locs)
    return pr.prepared(p, unit_lookup(spark), links(spark, sf), level, compat)


def tiled(spark, sf, routine="gemm", compat=True):
    return pr.with_tile_transfers(at_work(spark, sf, pr.LEVELS[routine], compat), routine, UNITS)


def us(column, digits=4):
    return r(column * 1e6, digits)


def by_problem(df):
    """Rows dealt to as many tasks as a shuffle has, by ``pid``, so that what a problem is spread out to meets in its own task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "pid")


V = "((D1::DOUBLE / T) * (D2::DOUBLE / T) * (D3::DOUBLE / T))"


@query("cm12_baseline", f"WITH {model_sql(3, 'la,lb,lc')} SELECT pid, mv, round((greatest(tt, greatest(3 * r, 1 * s)) * ({V} - 1) + tt + 3 * r + 1 * s) * 1e6, 4) + 0.0 AS baseline_us FROM q")
def cm12_baseline(spark, sf):
    """Three tiles in, one out for every task, from where most operands lie."""
    return tiled(spark, sf).select("pid", "mv", us(pr.steady("gemm", False)).alias("baseline_us"))


FAR = "(la <> unit)::INT + (lb <> unit)::INT + (lc <> unit)::INT"


@query("cm13_location_aware", f"WITH {model_sql(3, 'la,lb,lc')}, f AS (SELECT *, {FAR} AS i, (lc <> unit)::INT AS o FROM q) SELECT pid, round((greatest(tt, greatest(i * r, o * s)) * ({V} - 1) + tt + i * r + o * s) * 1e6, 4) + 0.0 AS aware_us FROM f")
def cm13_location_aware(spark, sf):
    """The same for operands that lie elsewhere only."""
    return tiled(spark, sf).select("pid", us(pr.steady("gemm", True)).alias("aware_us"))


BID_SQL = """z AS (SELECT f.*, a.ti + a.tb * (tile_bytes * i) * a.sl AS x, b.ti + b.tb * (tile_bytes * o) * b.sl AS y, a.ti AS ati, a.tb AS atb, a.sl AS asl, b.ti AS bti, b.tb AS btb, b.sl AS bsl FROM f JOIN sl a ON a.dest = unit AND a.src = mv JOIN sl b ON b.dest = mv AND b.src = unit),
ov AS (SELECT *, CASE WHEN i = 0 THEN CASE WHEN o = 0 THEN 0 ELSE bti + btb * tile_bytes * o END WHEN o = 0 THEN ati + atb * tile_bytes * i WHEN x <= y THEN x * (1 - 1 / bsl) + tile_bytes * o * btb + bti / bsl ELSE y * (1 - 1 / asl) + tile_bytes * i * atb + ati / asl END AS over_ FROM z)"""


@query("cm14_bidirectional", f"WITH {model_sql(3, 'la,lb,lc')}, f AS (SELECT *, {FAR} AS i, (lc <> unit)::INT AS o FROM q), {BID_SQL} SELECT pid, round(over_ * 1e6, 4) + 0.0 AS over_us, round((greatest(tt, over_) * ({V} - 1) + tt + i * r + o * s) * 1e6, 4) + 0.0 AS both_us FROM ov")
def cm14_bidirectional(spark, sf):
    """The same with both directions slowing each other."""
    far = [(F.col(f"loc_{x}") != F.col("unit")).cast("int") for x in "abc"]
    over = pr.opposed(F.col("tile_bytes") * (far[0] + far[1] + far[2]), F.col("tile_bytes") * far[2])
    return tiled(spark, sf).select("pid", us(over).alias("over_us"), us(pr.bidirectional("gemm")).alias("both_us"))


REUSE_SQL = f"""f AS (SELECT *, {FAR} AS i, (lc <> unit)::INT AS o, la <> unit AS fa, lb <> unit AS fb, lc <> unit AS fc, D1::DOUBLE / T AS e1, D2::DOUBLE / T AS e2, D3::DOUBLE / T AS e3 FROM q),
w AS (SELECT *, CASE WHEN fa THEN e1 * e3 ELSE 0 END + CASE WHEN fb THEN e3 * e2 ELSE 0 END + CASE WHEN fc THEN e1 * e2 ELSE 0 END AS every,
 CASE WHEN r > tt THEN CASE WHEN fa AND fb THEN e3 - 1 ELSE 0 END + CASE WHEN fa AND fc THEN e1 - 1 ELSE 0 END + CASE WHEN fb AND fc THEN e2 - 1 ELSE 0 END ELSE 0 END + CASE WHEN 2 * r > tt AND tt > r THEN e3 ELSE 0 END AS two FROM f),
o1 AS (SELECT *, every - (2 * two + i) AS one FROM w), o2 AS (SELECT *, e1 * e2 * e3 - 1 - (one + two) AS zero FROM o1),
reuse AS (SELECT *, tt * (1 + zero) + greatest(tt, r) * one + greatest(tt, 2 * r) * two + i * r + o * s AS total FROM o2)"""


@query("cm15_reuse", f"WITH {model_sql(3, 'la,lb,lc')}, {REUSE_SQL} SELECT pid, round(total * 1e6, 3) + 0.0 AS reuse_us FROM reuse")
def cm15_reuse(spark, sf):
    """Tasks by how many operands they still fetch, from where the operands lie."""
    return tiled(spark, sf).select("pid", us(pr.reuse(), 3).alias("reuse_us"))


@query("cm17_hetero_reuse", f"""WITH {model_sql(3, 'la,lb,lc')}, {REUSE_SQL} SELECT pid, round(total * (1 + 0.05::DOUBLE * (D1 % T <> 0)::INT + 0.05::DOUBLE * (D2 % T <> 0)::INT + 0.05::DOUBLE * (D3 % T <> 0)::INT)
* CASE WHEN ceil(D1::DOUBLE / T)::BIGINT * ceil(D2::DOUBLE / T)::BIGINT * ceil(D3::DOUBLE / T)::BIGINT % 4 <> 0 THEN 1.1::DOUBLE ELSE 1 END * ((unit + 1) / 10.0::DOUBLE) * 1e6, 3) + 0.0 AS share_us FROM reuse""")
def cm17_hetero_reuse(spark, sf):
    """The reuse time, raggedness and unevenness on top, for the unit's share of the problem."""
    value = pr.on_share(pr.reuse(), (F.col("unit") + 1) / 10.0, F.lit(4), 3)
    return tiled(spark, sf).select("pid", us(value, 3).alias("share_us"))


@query("cm16_pipeline", f"""WITH RECURSIVE {model_sql(3, 'la,lb,lc').replace('least(T_in, least(D1, D2, D3))', 'greatest(least(T_in, least(D1, D2, D3)), 500)')},
d AS (SELECT q.pid, q.unit, T, tt, l.ti + l.tb * tile_bytes AS rh, k.ti + k.tb * tile_bytes AS sh, (la <> q.unit)::INT AS fa, (lb <> q.unit)::INT AS fb, (lc <> q.unit)::INT AS fc,
 D1 // T + (D1 % T > T // 2)::INT AS g1, D2 // T + (D2 % T > T // 2)::INT AS g2, D3 // T + (D3 % T > T // 2)::INT AS g3,
 (CASE WHEN D1 % T > T // 2 THEN D1 % T ELSE D1 % T + T END)::DOUBLE / T AS l1, (CASE WHEN D2 % T > T // 2 THEN D2 % T ELSE D2 % T + T END)::DOUBLE / T AS l2, (CASE WHEN D3 % T > T // 2 THEN D3 % T ELSE D3 % T + T END)::DOUBLE / T AS l3
 FROM q JOIN link l ON l.dest = q.unit AND l.src = -1 JOIN link k ON k.dest = -1 AND k.src = q.unit),
run AS (SELECT *, 0::BIGINT AS sk, 0.0::DOUBLE AS work_, 0.0::DOUBLE AS link_, 0.0::DOUBLE AS adj FROM d UNION ALL
SELECT pid, unit, T, tt, rh, sh, fa, fb, fc, g1, g2, g3, l1, l2, l3, sk + 1, CASE WHEN sk = 0 THEN 0 ELSE greatest(link_, work_) + adj END,
 link_ + rh * (CASE WHEN ni = 0 THEN fa * e1 * e3 ELSE 0 END + CASE WHEN mi = 0 THEN fb * e2 * e3 ELSE 0 END + CASE WHEN ki = 0 THEN fc * e1 * e2 ELSE 0 END), tt * e1 * e2 * e3
 FROM (SELECT *, CASE WHEN mi = g1 - 1 THEN l1 ELSE 1 END AS e1, CASE WHEN ni = g2 - 1 THEN l2 ELSE 1 END AS e2, CASE WHEN ki = g3 - 1 THEN l3 ELSE 1 END AS e3 FROM (SELECT *, sk // (g2 * g3) AS mi, sk // g3 % g2 AS ni, sk % g3 AS ki FROM run WHERE sk < g1 * g2 * g3)))
SELECT pid, g1 * g2 * g3 AS tasks, round((greatest(work_, link_) + adj + l1 * l2 * sh * fc) * 1e6, 3) + 0.0 AS pipeline_us FROM run WHERE sk = g1 * g2 * g3""")
def cm16_pipeline(spark, sf):
    """The pipeline emulated task by task: first touches fetch, ragged last tiles."""
    locs = [(F.col(f"loc_{x}") - 1).alias(f"loc_{x}") for x in "abc"]
    p = problems(spark, sf).select("pid", "unit", "D1", "D2", "D3", F.greatest(F.least("T_in", "D1", "D2", "D3"), F.lit(500)).alias("T"), *locs)
    df = pr.prepared(p, unit_lookup(spark), links(spark, sf))
    parts = lambda d: F.floor(F.col(d) / F.col("T")) + (F.col(d) % F.col("T") > F.floor(F.col("T") / 2)).cast("int")
    return df.select("pid", (parts("D1") * parts("D2") * parts("D3")).cast("long").alias("tasks"), us(pr.pipeline(), 3).alias("pipeline_us"))


def lower_sql(level: int, ops: list[tuple[str, str, bool]], locs: str, compat: bool = True) -> str:
    """Whole transfers of a routine's operands ``(location, size, written)``."""
    rows = " UNION ALL ".join(f"SELECT pid, unit, {loc} AS loc, 8 * {size} AS b, {w} AS w FROM q" for loc, size, w in ops)
    return f"""{model_sql(level, locs, compat)}, op AS ({rows}), mo AS (SELECT o.pid, sum(l.ti + l.tb * b) FILTER (o.loc <> o.unit) AS came, sum(k.ti + k.tb * b) FILTER (w AND o.loc <> o.unit) AS went
 FROM op o JOIN link l ON l.dest = o.unit AND l.src = o.loc JOIN link k ON k.dest = o.loc AND k.src = o.unit GROUP BY o.pid), x AS (SELECT q.*, coalesce(came, 0) AS came, coalesce(went, 0) AS went FROM q JOIN mo USING (pid))"""


AXPY, GEMV = [("la", "D1", False), ("lb", "D1", True)], [("la", "D1 * D2", False), ("lb", "D2", False), ("lc", "D1", True)]
for _name, _routine, _compat, _sql in (
    ("cm18_level1", "axpy", True, lower_sql(1, AXPY, "la,lb")),
    ("cm18_level1_intended", "axpy", False, lower_sql(1, AXPY, "la,lb", False)),
    ("cm20_level2", "gemv", True, lower_sql(2, GEMV, "la,lb,lc")),
    ("cm20_level2_intended", "gemv", False, lower_sql(2, GEMV, "la,lb,lc", False)),
):
    @query(_name, f"WITH {_sql} SELECT pid, round(greatest(full_t, came, went) * 1e6, 4) + 0.0 AS full_us, round((full_t + came + went) * 1e6, 4) + 0.0 AS zero_us FROM x")
    def lower_level(spark, sf, routine=_routine, compat=_compat):
        """Full and no overlap of a vector or matrix-vector routine, with and without the cube and smallest-tile slips."""
        df = at_work(spark, sf, pr.LEVELS[routine], compat)
        return df.select("pid", us(pr.overlap(routine)).alias("full_us"), us(pr.overlap(routine, False)).alias("zero_us"))


for _name, _routine, _level, _locs, _far, _out in (("cm19_level1_bidirectional", "axpy", 1, "la,lb", "(la <> unit)::INT + (lb <> unit)::INT", "lb"), ("cm20_level2_bidirectional", "gemv", 2, "la,lb,lc", FAR, "lc")):
    @query(_name, f"""WITH {model_sql(_level, _locs)}, f AS (SELECT *, {_far} AS i, ({_out} <> unit)::INT AS o FROM q), {BID_SQL}, y AS (SELECT *, greatest(tt, over_) * (D1::DOUBLE / T - 1) + greatest(tt, o * s) + i * r + o * s AS total FROM ov)
SELECT pid, round(total * 1e6, 4) + 0.0 AS both_us, round(total * (1 + 0.05::DOUBLE * (D1 % T <> 0)::INT) * ((unit + 1) / 10.0::DOUBLE) * 1e6, 4) + 0.0 AS share_us FROM y""")
    def lower_both_ways(spark, sf, routine=_routine, level=_level):
        """Both directions at the lower levels, whole and for a unit's share."""
        both = pr.bidirectional(routine)
        return tiled(spark, sf, routine).select("pid", us(both).alias("both_us"), us(pr.on_share(both, (F.col("unit") + 1) / 10.0, F.lit(4), level)).alias("share_us"))


def streams_sql(b_in: str, b_out: str, k: str) -> str:
    return f"(SELECT greatest(a + k / n + d1, a1 + k + d1, a1 + k / n + d) FROM (SELECT n, k, ti * n + tb * bi AS a, ti + tb * bi / n AS a1, ui * n + ub * bo AS d, ui + ub * bo / n AS d1 FROM (SELECT {V} AS n, {k} AS k, {b_in} AS bi, {b_out} AS bo)))"


@query("cm21_streams", f"""WITH {model_sql(3, 'la,lb,lc')}, h AS (SELECT q.*, l.ti, l.tb, k.ti AS ui, k.tb AS ub, 8 * D1 * D3 AS ba, 8 * D3 * D2 AS bb, 8 * D1 * D2 AS bc, (la <> q.unit)::INT AS fa, (lb <> q.unit)::INT AS fb, (lc <> q.unit)::INT AS fc FROM q JOIN link l ON l.dest = q.unit AND l.src = -1 JOIN link k ON k.dest = -1 AND k.src = q.unit)
SELECT pid, round({streams_sql('ba + bb + bc', 'bc', 'full_t')} * 1e6, 4) + 0.0 AS all_us, round({streams_sql('fa * ba + fb * bb + fc * bc', 'fc * bc', 'full_t')} * 1e6, 4) + 0.0 AS far_us, round({streams_sql('fa * ba + fb * bb + fc * bc', 'fc * bc', f'tt * {V}')} * 1e6, 4) + 0.0 AS tile_us FROM h""")
def cm21_streams(spark, sf):
    """The streams model with the host, under its three byte policies."""
    return at_work(spark, sf).select("pid", *(us(pr.streams(p)).alias(f"{p}_us") for p in ("all", "far", "tile")))


BW_SQL = "8.0::DOUBLE * 2048 * 2048 / 1e9 / (ti + tb * 8.0::DOUBLE * 2048 * 2048)"
WEIGHT_SQL = f"bw AS (SELECT dest, src, ti, tb, CASE WHEN dest = src THEN 0 ELSE {BW_SQL} END AS bw FROM link)"


@query("lm1_link_bandwidth", f"WITH {LINK_SQL}, {WEIGHT_SQL} SELECT dest, src, round(CASE WHEN dest = src THEN 0 ELSE avg(bw) OVER (PARTITION BY tb) END, 6) + 0.0 AS bw FROM bw")
def lm1_link_bandwidth(spark, sf):
    """Bandwidths, those nearer than 5 % averaged: here the ones of equal time a byte, as 14 % lie between these."""
    return lk.weighted(link(spark, sf)).select("dest", "src", r("bw").alias("bw"))


def one_set(spark, workers, holders):
    return spark.range(1).select(F.lit(0).alias("set"), F.array(*map(F.lit, workers)).alias("workers"), F.array(*map(F.lit, holders)).alias("holders"))


@query("lm2_active_links", f"""WITH {LINK_SQL}, {WEIGHT_SQL}, a AS (SELECT *, dest <> src AND ((dest IN (0, 1) AND src IN (-1, 0, 1, 2)) OR (src IN (0, 1) AND dest IN (-1, 2))) AS on_ FROM bw),
f AS (SELECT *, on_ AND ((dest = 1 AND src = -1) OR (dest = -1 AND src = 1)) AS follows, CASE WHEN on_ AND (src = -1 OR dest = -1) AND greatest(dest, src) IN (0, 1) THEN 2.0 ELSE 1.0 END::DOUBLE AS share FROM a),
n AS (SELECT dest, src, avg(bw) OVER (PARTITION BY dest, tb) AS bw FROM f WHERE on_ AND NOT follows)
SELECT f.dest, f.src, CASE WHEN NOT on_ THEN -1 WHEN f.dest IN (0, 1) THEN 2 ELSE 1 END AS active, share, round(n.bw, 6) + 0.0 AS bw FROM f LEFT JOIN n ON n.dest = CASE WHEN follows AND f.dest = 1 THEN 0 ELSE f.dest END AND n.src = CASE WHEN follows AND f.src = 1 THEN 0 ELSE f.src END""")
def lm2_active_links(spark, sf):
    """Links of workers 0 and 1 with holders -1 and 2; of two links that share a way to the host the second has the first's bandwidth."""
    return lk.shared_links(lk.weighted(link(spark, sf), tolerance=0.0), one_set(spark, [0, 1], [-1, 2])).select("dest", "src", "active", "share", r("bw").alias("bw"))


@query("cm11_hetero_overlap", f"""WITH {model_sql(3, 'la,lb,lc')}, {WEIGHT_SQL}, sh AS (SELECT a.dest, a.src, a.ti, CASE WHEN (a.src = -1 AND a.dest IN (1, 3)) OR (a.dest = -1 AND a.src IN (1, 3)) THEN p.bw ELSE a.bw END AS bw, CASE WHEN a.dest <> a.src AND (a.src = -1 OR a.dest = -1) THEN 2 ELSE 1 END AS share
 FROM bw a JOIN bw p ON p.dest = CASE WHEN a.src = -1 AND a.dest IN (1, 3) THEN a.dest - 1 ELSE a.dest END AND p.src = CASE WHEN a.dest = -1 AND a.src IN (1, 3) THEN a.src - 1 ELSE a.src END),
op AS (SELECT pid, unit, (unit + 1) / 10.0::DOUBLE AS sc, unnest([la, lb, lc]) AS loc, unnest([8 * D1 * D3, 8 * D3 * D2, 8 * D1 * D2]) AS b, unnest([FALSE, FALSE, TRUE]) AS w FROM q),
mo AS (SELECT o.pid, sum(x.share * (x.ti + floor(b * sc) / (1e9 * x.bw))) FILTER (o.loc <> o.unit) AS came, sum(y.share * (y.ti + floor(b * sc) / (1e9 * y.bw))) FILTER (w AND o.loc <> o.unit) AS went FROM op o JOIN sh x ON x.dest = o.unit AND x.src = o.loc JOIN sh y ON y.dest = o.loc AND y.src = o.unit GROUP BY o.pid)
SELECT pid, round(full_t * ((unit + 1) / 10.0::DOUBLE) * 1e6, 4) + 0.0 AS exec_us, round(coalesce(came, 0) * 1e6, 4) + 0.0 AS recv_us, round(coalesce(went, 0) * 1e6, 4) + 0.0 AS send_us FROM q JOIN mo USING (pid)""")
def cm11_hetero_overlap(spark, sf):
    """A unit's share of the work, received and sent over the shared links of four working units."""
    shared = lk.shared_links(lk.weighted(link(spark, sf), tolerance=0.0), one_set(spark, [0, 1, 2, 3], [-1]), 0.0).select("dest", "src", "bw", "share")
    df = pr.linked(at_work(spark, sf), shared)
    did, came, went = pr.hetero_overlap((F.col("unit") + 1) / 10.0)
    return df.select("pid", us(did).alias("exec_us"), us(came).alias("recv_us"), us(went).alias("send_us"))


@query("cm23_best_reuse_transfer", f"""WITH {PROB_SQL}, {LINK_SQL}, {WEIGHT_SQL}, u AS (SELECT k FROM range(4) x(k)), perm AS (SELECT row_number() OVER (ORDER BY a.k, b.k, c.k, d.k) - 1 AS pm, [a.k, b.k, c.k, d.k] AS l FROM u a, u b, u c, u d WHERE a.k <> b.k AND a.k <> c.k AND a.k <> d.k AND b.k <> c.k AND b.k <> d.k AND c.k <> d.k),
pl AS (SELECT pm, k AS place, l[k + 1] AS unit FROM perm, u), pa AS (SELECT a.pm, a.unit, sum(w.bw) FILTER (a.place // 2 = b.place // 2) * 0.8::DOUBLE AS row_bw, sum(w.bw) FILTER (a.place % 2 = b.place % 2) * 0.8::DOUBLE AS col_bw FROM pl a JOIN pl b ON a.pm = b.pm AND a.place <> b.place AND (a.place // 2 = b.place // 2 OR a.place % 2 = b.place % 2) JOIN bw w ON w.dest = a.unit AND w.src = b.unit GROUP BY ALL),
c AS (SELECT pid, pm, max(CASE WHEN loc_a - 1 <> pa.unit THEN floor(8 * D1 * D3 * ((pa.unit + 1) / 10.0::DOUBLE)) / (col_bw * 1e9) ELSE 0 END + CASE WHEN loc_b - 1 <> pa.unit THEN floor(8 * D3 * D2 * ((pa.unit + 1) / 10.0::DOUBLE)) / (row_bw * 1e9) ELSE 0 END) AS sec FROM prob, pa GROUP BY ALL)
SELECT pid, round(max(sec) FILTER (pm = 0) * 1e6, 4) + 0.0 AS as_listed_us, round(min(sec) * 1e6, 4) + 0.0 AS best_us FROM c GROUP BY pid""")
def cm23_best_reuse_transfer(spark, sf):
    """What four units in a 2 x 2 layout get from their row and column: the slowest one's time, as listed and for the best order."""
    placed = tn.permutations(spark, 4).select("place", F.posexplode("units").alias("at", "unit"))
    other = placed.select("place", F.col("at").alias("oat"), F.col("unit").alias("src"))
    row, col = F.floor(F.col("at") / 2) == F.floor(F.col("oat") / 2), F.col("at") % 2 == F.col("oat") % 2
    weights = lk.weighted(link(spark, sf), tolerance=0.0).select(F.col("dest").alias("unit"), "src", "bw")
    pair = placed.join(other, "place").where((F.col("at") != F.col("oat")) & (row | col)).join(F.broadcast(weights), ["unit", "src"])
    damped = lambda side: F.sum(F.when(side, F.col("bw"))) * F.pow(F.lit(1 - se.HOP_COST), F.count_if(side))
    layout = pair.groupBy("place", "unit").agg(damped(row).alias("row_bw"), damped(col).alias("col_bw")).groupBy("place").agg(F.collect_list(F.struct("unit", "row_bw", "col_bw")).alias("l"))
    layouts = layout.agg(F.array_sort(F.collect_list(F.struct("place", "l"))).alias("layouts"))
    score = lambda x: (x["unit"] + 1) / 10.0
    part = lambda loc, size, x, bw: F.when(F.col(loc) - 1 != x["unit"], F.floor(8 * size * score(x)) / (x[bw] * 1e9)).otherwise(0.0)
    sec = lambda x: part("loc_a", F.col("D1") * F.col("D3"), x, "col_bw") + part("loc_b", F.col("D3") * F.col("D2"), x, "row_bw")
    slowest = F.transform("layouts", lambda o: F.array_max(F.transform(o["l"], sec)))
    # an order is no row: rows are dealt by problem first, and a problem's orders stay in its row
    each = by_problem(problems(spark, sf)).crossJoin(F.broadcast(layouts)).select("pid", slowest.alias("sec"))
    orders = math.factorial(4)
    one = each.groupBy("pid").agg(*(F.max(F.col("sec")[k]).alias(f"_{k}") for k in range(orders)))
    return one.select("pid", us(F.col("_0")).alias("as_listed_us"), us(F.least(*(F.col(f"_{k}") for k in range(orders)))).alias("best_us"))


@query("cm26_best_friends", f"WITH {LINK_SQL}, {WEIGHT_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY bw DESC, src) AS p FROM bw WHERE dest <> src), s AS (SELECT *, floor(greatest(0, least(1, 2.5 - (p - 1)))::DOUBLE / 2.5::DOUBLE * 33554432) AS part FROM k) SELECT dest, round(sum(CASE WHEN part > 0 THEN ti + part / (bw * 1e9) ELSE 0 END) * 1e6, 4) + 0.0 AS sec_us FROM s GROUP BY dest")
def cm26_best_friends(spark, sf):
    """Seconds for 32 MiB from the fastest peers, two and a half of them."""
    w = lk.weighted(link(spark, sf), tolerance=0.0).where("dest <> src")
    return tn.best_friends_seconds(w, 2.5, F.lit(33554432)).select("dest", us(F.col("sec")).alias("sec_us"))


KIND_SQL = "kinds AS (SELECT DISTINCT (1999 * (1 + p_size % 7))::BIGINT AS D1, (2304 * (1 + p_partkey % 5))::BIGINT AS D2, (2048 * (1 + p_partkey // 5 % 9))::BIGINT AS D3, (1 + p_partkey % 4)::BIGINT AS u FROM part)"
TERM_SQL = """b AS (SELECT *, ceil(D1::DOUBLE / T)::BIGINT * ceil(D2::DOUBLE / T)::BIGINT AS bl, ceil(D1::DOUBLE / T)::BIGINT * ceil(D2::DOUBLE / T)::BIGINT * ceil(D3::DOUBLE / T)::BIGINT // u AS k FROM ts),
sl AS (SELECT *, CASE WHEN bl // u > 0 THEN (bl % u)::DOUBLE / (bl // u) * u ELSE bl::DOUBLE / u END AS c1, (CASE WHEN D1 % T <> 0 THEN 1.0::DOUBLE / (D1 // T) ELSE 0 END) + (CASE WHEN D2 % T <> 0 THEN 1.0::DOUBLE / (D2 // T) ELSE 0 END) + (CASE WHEN D3 % T <> 0 THEN 1.0::DOUBLE / (D3 // T) ELSE 0 END) AS c2,
 CASE WHEN T < 2048 THEN 2048.0::DOUBLE / T * 0.2::DOUBLE ELSE 0 END AS c3, CASE WHEN k = 0 THEN 'inf'::DOUBLE ELSE 2.0::DOUBLE / k + CASE WHEN k > 512 THEN k / 512.0::DOUBLE * 0.1::DOUBLE ELSE 0 END END AS c4, CASE WHEN T > 4096 THEN (T // 4096) * 0.1::DOUBLE ELSE 0 END AS c5 FROM b)"""


def kinds(spark, sf):
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        (1999 * (1 + F.col("p_size") % 7)).cast("long").alias("D1"), (2304 * (1 + key % 5)).cast("long").alias("D2"), (2048 * (1 + F.expr("p_partkey div 5") % 9)).cast("long").alias("D3"), (1 + key % 4).cast("long").alias("units")).distinct()


@query("tn1_tile_slowdown", f"WITH {KIND_SQL}, ts AS (SELECT *, unnest(list_distinct(list_concat(range(256, least(D1, D2, D3) + 1, 256), [least(D1, D2, D3)]))) AS T FROM kinds), {TERM_SQL} SELECT D1, D2, D3, u AS units, T, round(c1, 6) + 0.0 AS imbalance, round(c2, 6) + 0.0 AS remainder, round(c3, 6) + 0.0 AS small, round(c4, 6) + 0.0 AS count, round(c5, 6) + 0.0 AS big, round(c1 + c2 + c3 + c4 + c5, 6) + 0.0 AS sl FROM sl")
def tn1_tile_slowdown(spark, sf):
    """The five penalties of every 256th tile size and the largest one."""
    low, step = F.least("D1", "D2", "D3"), F.lit(256).cast("long")
    each = kinds(spark, sf).select("*", F.explode(F.array_distinct(F.concat(F.sequence(step, low, step), F.array(low)))).alias("T"))
    args = [F.col(c) for c in ("T", "D1", "D2", "D3", "units")]
    return each.select("D1", "D2", "D3", "units", "T", *(r(x).alias(k) for k, x in tn.tile_terms(*args).items()), r(tn.tile_slowdown(*args)).alias("sl"))


@query("tn2_best_tile", f"WITH {KIND_SQL}, ts AS (SELECT *, unnest(range(1, least(D1, D2, D3) + 1)) AS T FROM kinds), {TERM_SQL}, m AS (SELECT D1, D2, D3, u, T, round(c1 + c2 + c3 + c4 + c5, 9) AS sl FROM sl) SELECT D1, D2, D3, u AS units, arg_min(T, (sl, -T)) AS T, round(min(sl), 6) + 0.0 AS slowdown FROM m GROUP BY ALL")
def tn2_best_tile(spark, sf):
    """Least penalty over all tile sizes up to the least dimension; ties keep the larger. The SQL tries every size."""
    k = kinds(spark, sf).withColumn("pid", F.struct("D1", "D2", "D3", "units"))
    return tn.best_tile(k).select("pid.D1", "pid.D2", "pid.D3", "pid.units", "T", r("slowdown").alias("slowdown"))


@query("tn8_warnings", f"WITH {KIND_SQL}, ts AS (SELECT *, least(D1, D2, D3, 256 * (1 + (D1 + D2 // 256 + D3) % 23)) AS T FROM kinds), {TERM_SQL}, w AS (SELECT *, CASE WHEN k > 512 THEN k / 512.0::DOUBLE * 0.1::DOUBLE ELSE 0 END AS many FROM sl) SELECT D1, D2, D3, u AS units, T, concat_ws(',', CASE WHEN c1 > 0 THEN 'C1' END, CASE WHEN c2 > 0 THEN 'C2' END, CASE WHEN c3 > 0 THEN 'C3' END, CASE WHEN many > 0 THEN 'C4' END, CASE WHEN c5 > 0 THEN 'C5' END) AS violated, round(CASE WHEN c1 > 0 THEN c1 ELSE 0 END + c2 + c3 + many + c5, 6) + 0.0 AS cost FROM w")
def tn8_warnings(spark, sf):
    """Tuning conditions that a tile violates, by its penalties."""
    d = [F.col(c) for c in ("D1", "D2", "D3")]
    k = kinds(spark, sf).withColumn("T", F.least(*d, 256 * (1 + (F.col("D1") + F.expr("D2 div 256") + F.col("D3")) % 23)))
    up = lambda x: F.ceil(x / F.col("T")).cast("long")
    w = k.withColumn("w", tn.warnings(F.col("T"), *d, F.col("units"), up(d[0]) * up(d[1]) * up(d[2])))
    return w.select("D1", "D2", "D3", "units", "T", F.array_join(F.transform("w", lambda x: x["name"]), ",").alias("violated"), r(F.aggregate("w", F.lit(0.0), lambda a, x: a + x["slowdown"])).alias("cost"))


@query("tn5_normalised_split", f"""WITH RECURSIVE {PROB_SQL}, s AS (SELECT pid, [0.04::DOUBLE, score / 4, (unit + 1) / 8.0::DOUBLE, 0.3::DOUBLE] AS s FROM prob), st AS (SELECT pid, 0 AS i, list_transform(s, lambda x: x / list_sum(s)) AS v FROM s UNION ALL
SELECT pid, i + 1, CASE WHEN v[i + 1] < 0.05::DOUBLE THEN list_transform(range(1, 5), lambda k: CASE WHEN k = i + 1 THEN 0 ELSE v[k] / (1 - v[i + 1]) END)
 ELSE list_transform(range(1, 5), lambda k: CASE WHEN k = i + 1 OR (k > i + 1 AND abs(v[k] - v[i + 1]) < 0.05::DOUBLE * 4 * v[i + 1]) THEN list_avg(list_transform(list_filter(range(1, 5), lambda j: j = i + 1 OR (j > i + 1 AND abs(v[j] - v[i + 1]) < 0.05::DOUBLE * 4 * v[i + 1])), lambda j: v[j])) ELSE v[k] END) END FROM st WHERE i < 4)
SELECT pid, round(v[1], 8) + 0.0 AS s0, round(v[2], 8) + 0.0 AS s1, round(v[3], 8) + 0.0 AS s2, round(v[4], 8) + 0.0 AS s3 FROM st WHERE i = 4""")
def tn5_normalised_split(spark, sf):
    """Small scores dropped, near ones averaged."""
    s = F.array(F.lit(0.04), F.col("score") / 4, (F.col("unit") + 1) / 8.0, F.lit(0.3))
    one = pr.let(s, lambda v: pr.let(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), lambda t: F.transform(v, lambda x: x / t)))
    n = problems(spark, sf).select("pid", one.alias("s")).select("pid", tn.normalised_split(F.col("s")).alias("s"))
    return n.select("pid", *(r(F.col("s")[k], 8).alias(f"s{k}") for k in range(4)))


def search_problems(spark, sf):
    target = F.element_at(F.array(*map(F.lit, se.TARGETS)), (F.col("pid") % 5 + 1).cast("int"))
    dims = [(F.col(d) * 4 + 64 * k).alias(d) for k, d in enumerate(("D1", "D2", "D3"))]
    return problems(spark, sf).select("pid", *dims, *((F.col(f"loc_{x}") - 1).alias(f"loc_{x}") for x in "abc"), target.alias("target"))


@query("tn4_split_ratios")
def tn4_split_ratios(spark, sf):
    """The split of every problem over all four units for its target, and what it predicts; checked against a loop in tests."""
    s = se.best_split(search_problems(spark, sf), lk.weighted(link(spark, sf)), unit_lookup(spark), 4)
    return s.select("pid", "T", *(r(F.col("scores")[k], 7).alias(f"s{k}") for k in range(4)), *(r(k, 7).alias(k) for k in ("sec", "joules", "pdp", "edp")))


@query("tn6_subset_search")
def tn6_subset_search(spark, sf):
    """The units that each problem should run on, for one of five targets; checked against a loop in tests."""
    best = se.best_subset(search_problems(spark, sf), lk.weighted(link(spark, sf)), unit_lookup(spark), 4)
    return best.select("pid", "case", "T", "n", F.array_join(F.transform("scores", lambda s: F.format_number(s, 5)), ",").alias("scores"), *(r(k, 7).alias(k) for k in ("sec", "joules", "pdp", "edp")))


@query("tn7_plan_difference", "WITH p AS (SELECT p_partkey AS pid, 256 * (1 + p_size % 8) AS ta, CASE WHEN p_partkey % 5 = 0 THEN -1 ELSE 256 * (1 + p_size % 4) END AS tb, range(p_partkey % 3 + 1) AS ua, range(p_partkey % 4) AS ub, p_partkey % 2 * 64 AS ca, p_size % 3 * 64 AS cb FROM part) SELECT pid, (tb <> -1 AND ta <> tb)::INT + (len(ub) > 0 AND ua <> ub)::INT + (cb <> 0 AND ca <> cb)::INT AS differing FROM p")
def tn7_plan_difference(spark, sf):
    """In how many preset fields a plan differs from another; fields left open don't count."""
    k, s = F.col("p_partkey"), F.col("p_size")
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    a = {"T": 256 * (1 + s % 8), "units": upto(k % 3 + 1), "cache_limit": k % 2 * 64}
    b = {"T": F.when(k % 5 == 0, -1).otherwise(256 * (1 + s % 4)), "units": upto(k % 4), "cache_limit": s % 3 * 64}
    return table(spark, sf, "part").select(k.alias("pid"), tn.differing(a, b).alias("differing"))


@query("ds5_block", """WITH k AS (SELECT DISTINCT 2 + p_size % 7 AS g1, (3 + p_partkey % 5)::INT AS g2, (1 + p_partkey % 2)::INT AS g3, (CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 ELSE 6 END)::INT AS n FROM part),
g AS (SELECT *, CASE n WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS p1, CASE n WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 2 END AS p2 FROM k), d AS (SELECT *, g1 // p1 * p1 AS d1, g2 // p2 * p2 AS d2 FROM g),
c AS (SELECT d.*, mi, ni, CASE WHEN g1 < p1 OR g2 < p2 THEN 0 WHEN mi < d1 AND ni < d2 THEN 1 WHEN mi < d1 THEN 2 WHEN ni < d2 THEN 3 ELSE 4 END AS region FROM d, range(0, 9) a(mi), range(0, 8) b(ni) WHERE mi < g1 AND ni < g2),
x AS (SELECT *, row_number() OVER (PARTITION BY g1, g2, g3, n, region ORDER BY mi, ni) - 1 AS place FROM c)
SELECT g1::BIGINT AS g1, g2::BIGINT AS g2, g3::BIGINT AS g3, n::INT AS n, mi, ni, (CASE WHEN region = 1 THEN mi // (g1 // p1) * p2 + ni // (g2 // p2) ELSE place % n END)::INT AS unit FROM x""")
def ds5_block(spark, sf):
    """Blocks of grids of many sizes over 2 to 6 equal units; remainders and grids narrower than the layout in turns."""
    k, n = F.col("p_partkey"), F.col("n")
    g = table(spark, sf, "part").select((2 + F.col("p_size") % 7).cast("long").alias("g1"), (3 + k % 5).cast("long").alias("g2"), (1 + k % 2).cast("long").alias("g3"), F.when(k % 4 == 0, 2).when(k % 4 == 1, 3).when(k % 4 == 2, 4).otherwise(6).alias("n")).distinct()
    p = g.select(F.struct("g1", "g2", "g3", "n").alias("pid"), "g1", "g2", "g3", F.transform(F.sequence(F.lit(1), n), lambda x: F.lit(1.0) / n).alias("scores"))
    return tn.block_units(p.withColumn("pid", F.col("g1") * 10000 + F.col("g2") * 1000 + F.col("g3") * 100 + F.size("scores"))).select(
        F.expr("pid div 10000").alias("g1"), F.expr("pid div 1000 % 10").alias("g2"), F.expr("pid div 100 % 10").alias("g3"), (F.col("pid") % 100).cast("int").alias("n"), "mi", "ni", "unit")


@query("ds5_block_uneven")
def ds5_block_uneven(spark, sf):
    """Blocks under unequal quotas: what is over a unit's spills to the next with room; checked against a loop in tests."""
    k = F.col("p_partkey")
    s = F.array(0.1 + F.col("p_size") % 3 * 0.1, F.lit(0.25), F.lit(0.2), 0.45 - F.col("p_size") % 3 * 0.1)
    p = table(spark, sf, "part").select((2 + F.col("p_size") % 9).cast("long").alias("g1"), (2 + k % 11).cast("long").alias("g2"), F.lit(2).cast("long").alias("g3"), s.alias("scores")).distinct()
    return tn.block_units(p.withColumn("pid", F.xxhash64("g1", "g2", "scores"))).select("pid", "mi", "ni", "unit")


#: As ``model_sql``, with a row for each benchmarked tile that a problem allows.
BENCHED_SQL = model_sql(3, "la,lb,lc").replace("SELECT pid, unit, D1, D2, D3, least(T_in, least(D1, D2, D3))::BIGINT AS T", "SELECT pid * 100 + b.T // 256 AS pid, unit, D1, D2, D3, b.T AS T").replace("FROM prob), \nq1", "FROM prob), q1").replace("loc_c - 1 AS lc FROM prob)", "loc_c - 1 AS lc FROM prob JOIN lookup b ON b.T <= least(D1, D2, D3))")


@query("tn3_best_benchmarked", f"""WITH {BENCHED_SQL}, {REUSE_SQL}, timed AS (SELECT pid // 100 AS pid, T, round(greatest(tt, greatest(i * r, o * s)) * ({V} - 1) + tt + i * r + o * s, 10) AS aware, round(total, 10) AS reuse FROM reuse)
SELECT pid, arg_min(T, (aware, T)) FILTER (aware >= 0) AS T_aware, round(min(aware) FILTER (aware >= 0) * 1e6, 4) + 0.0 AS aware_us, arg_min(T, (reuse, T)) FILTER (reuse >= 0) AS T_reuse, round(min(reuse) FILTER (reuse >= 0) * 1e6, 4) + 0.0 AS reuse_us FROM timed GROUP BY pid""")
def tn3_best_benchmarked(spark, sf):
    """The benchmarked tile of least predicted time, by the location-aware and by the reuse model; of equal ones the first."""
    locs = [(F.col(f"loc_{x}") - 1).alias(f"loc_{x}") for x in "abc"]
    tiles = F.broadcast(lookup(spark).select(F.col("T").alias("bench")))
    each = by_problem(problems(spark, sf)).join(tiles, F.col("bench") <= F.least("D1", "D2", "D3")).select("pid", "unit", "D1", "D2", "D3", F.col("bench").alias("T"), *locs)
    at = pr.with_tile_transfers(pr.prepared(each, unit_lookup(spark), links(spark, sf)), "gemm", UNITS)
    timed = at.select("pid", "T", pr.steady("gemm", True).alias("aware"), pr.reuse().alias("reuse"))
    both = timed.groupBy("pid").agg(tn.first_of_best("aware", 10).alias("a"), tn.first_of_best("reuse", 10).alias("b"))
    return both.select("pid", F.col("a.T").alias("T_aware"), us(F.col("a.sec")).alias("aware_us"), F.col("b.T").alias("T_reuse"), us(F.col("b.sec")).alias("reuse_us"))
