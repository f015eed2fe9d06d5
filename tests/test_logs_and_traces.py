import pytest
from pyspark.sql import functions as F
from tilewright.operators import traces
from tilewright.plans import links as lk
from tilewright.sources import logs, paths, sinks
from tilewright.streaming.traces import windowed_link_stats

TRACE = "src int, dest int, route string, bytes long, fire_t double, sced_t double, complete_t double"


def test_wrong_field_counts_are_fatal(spark, tmp_path):
    (tmp_path / "x.log").write_text("0,1,[ 0 1 ],8,0.0,1.0\n")
    with pytest.raises(Exception, match="FAILED_READ_FILE|MALFORMED"):
        logs.read(spark, f"file://{tmp_path}", "trace").collect()


def test_names_tell_devices_and_flags(spark, tmp_path):
    for name in ("cublasDgemm_dev--1_TransA-N_TransB-T_1.1.log", "cublasDgemm_dev-10_TransA-T_TransB-N_1.1.log"):
        (tmp_path / name).write_text("256, 256, 256, 1.5e-3, -1, -1, 0.01, 11, 2.0\n512,512,512,2e-3,-1,-1,0.01,11,2.0\n")
    got = {(r.func, r.dev, r.trans_a, r.trans_b, r.M) for r in logs.read_benchmarks(spark, f"file://{tmp_path}").collect()}
    assert got == {("Dgemm", d, a, b, m) for d, a, b in ((-1, "N", "T"), (10, "T", "N")) for m in (256, 512)}


def test_lookup_and_link_model_texts(spark, tmp_path):
    rows = spark.createDataFrame([("Dgemm", 0, "N", "N", m, m, m, 0.5, -1.0, -1.0, 0.01, 11, 1.0) for m in (512, 256)], "func string, dev int, trans_a string, trans_b string, M long, N long, K long, mean_t double, w_avg double, joules double, margin_err double, samples long, bench_t double")
    sinks.write_lookup(rows, f"file://{tmp_path}/l")
    assert [r.T for r in logs.read(spark, f"file://{tmp_path}/l", "lookup_l3", "lookup_l3").collect()] == [256, 512]
    models = spark.createDataFrame([(-1, 0, 1e-5, 8e-11)], "dest int, src int, ti double, tb double")
    slow = spark.createDataFrame([(-1, 0, 1, 0, s) for s in (0.5, 1.03, 1.5, 9.0)], "dest int, src int, osrc int, odest int, sl double")
    sinks.write_link_models(models, slow, f"file://{tmp_path}/m")
    back, slowdowns = logs.read_link_models(spark, f"file://{tmp_path}/m")
    assert [tuple(r) for r in back.collect()] == [(-1, 0, 1e-5, 8e-11)]
    assert sorted(r.sl for r in slowdowns.collect()) == [1.0, 1.0, 1.5, 2.0]


def test_appending_twice_leaves_one(spark, tmp_path):
    names = [x.split()[0] for x in logs.SCHEMAS["run18"].split(", ")]
    values = [512, 1, 1, 0, "N", "N", 1.0, 0.0, 9, 9, 9, 0, 0, 0, 0, 0.5, 0.4, 3.0]
    runs = spark.createDataFrame([tuple(values), tuple(values), tuple([1024, *values[1:]])], logs.SCHEMAS["run18"])
    path = f"file://{tmp_path}/runs"
    assert sinks.append_new(runs.where("T = 512"), path).count() == 1
    sinks.append_new(runs, path)
    assert sorted(r.T for r in logs.read(spark, path, "run18").collect()) == [512, 1024] and names[0] == "T"


def test_routes(spark):
    rows = [(0, 6, "[ 0 2 6 ]", 100, 0.0, 1.0, 2.0), (1, 1, "[ 1 1 ]", 100, 0.0, 1.0, 2.0), (3, -1, "[ 3 -1 ]", 100, 0.0, 1.0, 2.0), (5, 5, "[ 5 ]", 1, 0.0, 1.0, 2.0), (5, 5, None, 1, 0.0, 1.0, 2.0)]
    t = spark.createDataFrame(rows, TRACE)
    assert {(r.src, r.dest, r.hop) for r in traces.unchained(t).collect()} == {(0, 2, 0), (2, 6, 1), (1, 1, 0), (3, -1, 0)}
    stats = traces.link_stats(traces.transfer_metrics(t))
    assert {(r.dest, r.src) for r in stats.collect()} == {(6, 0), (-1, 3)}
    assert traces.link_matrix(stats, [-1, 0, 3], "n").columns == ["dest", "from_h", "from_0", "from_3"]


def test_transfers_without_time_have_no_rate(spark):
    t = spark.createDataFrame([(0, 1, "[ 0 1 ]", 100, 0.0, 1.0, 1.0), (0, 1, "[ 0 1 ]", 10**9, 0.0, 1.0, 2.0)], TRACE)
    m = traces.transfer_metrics(t)
    assert sorted((r.transfer_t, r.gbs) for r in m.collect()) == [(0.0, None), (1.0, 1.0)]
    assert [(r.n, r.gbs) for r in traces.link_stats(m).collect()] == [(1, 1.0)]


def test_streamed_links_equal_the_batch(spark, tmp_path):
    rows = [(k % 3, (k + 1) % 3, f"[ {k % 3} {(k + 1) % 3} ]", 64, 0.0, 1.0, 2.0 + k) for k in range(60)]
    t = spark.createDataFrame(rows, TRACE).withColumn("ts", F.expr("timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(complete_t * 5 as int))"))
    t.repartition(3).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = windowed_link_stats(stream).writeStream.outputMode("complete").format("memory").queryName("links").start()
    query.processAllAvailable()
    query.stop()
    key = lambda df: sorted((r.begin, r.dest, r.src, r.n, r.bytes) for r in df.collect())
    assert key(spark.table("links")) == key(windowed_link_stats(t))


def test_rebalanced_is_the_loop(spark):
    edges = [(d, s, 1.0 if (d, s) == (0, 1) else 40.0) for d in range(3) for s in range(3) if d != s]
    moves = [(0, 1, 4_000_000_000), (2, 1, 1000), (1, 0, 1000)]
    e, t = spark.createDataFrame(edges, "dest int, src int, bw double"), spark.createDataFrame(moves, "dest int, src int, bytes long")

    def eta(via):
        load = dict.fromkeys([(d, s) for d, s, _ in edges], 0)
        for d, s, b in moves:
            for link in [(d, s)] if via[d, s] is None else [(via[d, s], s), (d, via[d, s])]:
                load[link] += b
        return {(d, s): load[d, s] / (bw * 1e9) for d, s, bw in edges}

    via = {(d, s): None for d, s, _ in moves}
    for _ in range(4):
        now = eta(via)
        best = {(d, s): min((max(now[u, s], now[d, u]), u) for u in range(3) if u not in (d, s)) for d, s in via}
        via = {(d, s): best[d, s][1] if v is None and best[d, s][0] < 0.8 * now[d, s] else v for (d, s), v in via.items()}
    got = {(r.dest, r.src): r.via for r in lk.rebalanced(t, e).collect()}
    assert got == via and via[0, 1] == 2


def plainly_balanced(moves, bw, rounds, tolerance, weight):
    """The same descent over dictionaries."""
    pairs = {}
    for d, s, b in moves:
        if d != s and b is not None:
            pairs[d, s] = pairs.get((d, s), 0) + b
    units = sorted({u for l in bw for u in l})
    ways = {p: [(v, [p] if v is None else [(v, p[1]), (p[0], v)]) for v in [None, *units]] for p in pairs}
    ways = {p: [w for w in ws if all(l in bw for l in w[1])] for p, ws in ways.items()}

    def etas(choice):
        load = dict.fromkeys(bw, 0.0)
        for p, (_, links) in choice.items():
            for l in links:
                load[l] += pairs[p]
        return {l: load[l] / (bw[l] * 1e9) for l in bw}

    n, mean = len(bw), lambda x: sum(x.values()) / len(bw)
    inner = lambda x, y: sum(x[l] * y[l] for l in bw) / n - mean(x) * mean(y) + weight * mean(x) * mean(y)
    choice = {p: ws[0] for p, ws in ways.items() if ws}
    share, eta = {(p, w[0]): 1.0 for p, w in choice.items()}, etas(choice)
    values = [inner(eta, eta)]
    for _ in range(rounds):
        cost = {l: (eta[l] - (1 - weight) * mean(eta)) / bw[l] for l in bw}
        choice = {p: min(ws, key=lambda w: sum(cost[l] for l in w[1])) for p, ws in ways.items() if ws}
        to = etas(choice)
        way = {l: to[l] - eta[l] for l in bw}
        slope, bend = inner(eta, way), inner(way, way)
        if bend <= 0 or -2 * slope <= tolerance * values[-1]:
            break
        step = min(1.0, -slope / bend)
        share = {k: v * (1 - step) for k, v in share.items()}
        for p, w in choice.items():
            share[p, w[0]] = share.get((p, w[0]), 0.0) + step
        eta = {l: eta[l] + step * way[l] for l in bw}
        values.append(inner(eta, eta))
    return pairs, share, values


@pytest.mark.parametrize("weight", [1.0, 0.25])
def test_balanced_is_the_plain_descent(spark, weight):
    bw = {(d, s): 3.0 + (7 * d + 5 * s) % 11 + 0.125 * d for d in range(4) for s in range(4) if d != s and (d, s) != (3, 0)}
    moves = [(0, 1, 4_000_000_000), (0, 1, 3_500_000_000), (2, 1, 900_000_000), (1, 3, 70_000), (3, 0, 2_000_000_000), (2, 2, 5), (1, 2, None), (9, 0, 8)]
    e = spark.createDataFrame([(*k, v) for k, v in bw.items()] + [(1, 1, 0.0), (3, 0, 0.0)], "dest int, src int, bw double")
    flows, objective = lk.balanced(spark.createDataFrame(moves, "dest int, src int, bytes long"), e, 5, 1e-6, weight)
    pairs, share, values = plainly_balanced(moves, bw, 5, 1e-6, weight)
    assert len(values) > 2 and objective == pytest.approx(values, rel=1e-9)
    assert all(b <= a for a, b in zip(objective, objective[1:])) and objective[-1] < 0.7 * objective[0]
    rows = flows.collect()
    assert {(r.dest, r.src): r.bytes for r in rows} == pairs
    got = {((r.dest, r.src), r.via): r.share for r in rows if r.share is not None}
    assert got == pytest.approx({k: v for k, v in share.items() if v > 0}, abs=1e-9)
    # no path: told so, not lost; (3, 0) has no link of its own
    assert [r.share for r in rows if r.dest == 9] == [None] and None not in {r.via for r in rows if (r.dest, r.src) == (3, 0)}


def test_nothing_to_balance(spark):
    none = spark.createDataFrame([], "dest int, src int, bytes long")
    e = spark.createDataFrame([(0, 1, 2.0)], "dest int, src int, bw double")
    flows, objective = lk.balanced(none, e)
    assert flows.count() == 0 and objective == [0.0]
    assert lk.balanced(none, e.limit(0))[1] == [0.0]


def test_what_passes_is_deleted(spark):
    with paths.passing(spark) as made:
        first = paths.staged(spark.range(3), "first")
        second = paths.staged(first, "second")
        kept = [made.pop()]
        (gone,) = made
    assert second.count() == 3 and kept[0].split("/")[-1].startswith("second")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(gone)
    paths.discard(spark, kept)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(kept[0])
