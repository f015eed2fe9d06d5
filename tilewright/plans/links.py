"""The link map: bandwidths, shared links, one-hop routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.functions.metrics import near_groups, running_near
from tilewright.sources.paths import staged


def bandwidth(ti: Column, tb: Column, tile: int = 2048) -> Column:
    """GB/s of a square of ``tile`` doubles."""
    size = 8.0 * tile * tile
    return F.lit(size / 1e9) / (ti + tb * size)


def resolved(edges: DataFrame) -> DataFrame:
    """``bw_shared`` of -1 is the partner link's (``p_dest``, ``p_src``); where that has none either, the link's own bandwidth."""
    p = edges.select(F.col("dest").alias("_d"), F.col("src").alias("_s"), F.nullif(F.col("bw_shared"), F.lit(-1.0)).alias("_b"))
    joined = edges.join(p, (F.col("p_dest") == F.col("_d")) & (F.col("p_src") == F.col("_s")), "left")
    return joined.select("dest", "src", "bw", F.when(F.col("bw_shared") == -1, F.coalesce("_b", "bw")).otherwise(F.col("bw_shared")).alias("bw_shared"))


def weighted(links: DataFrame, tile: int = 2048, tolerance: float = 0.05) -> DataFrame:
    """``(dest, src, ti, tb, bw)``: each link's bandwidth for a square of ``tile`` doubles, near ones averaged.

    Averaging goes by pivots in order of the links, units first and the host last. Links to a unit itself have 0.
    """
    order = lambda c: F.when(F.col(c) < 0, F.lit(1 << 30)).otherwise(F.col(c))
    bw = F.when(F.col("dest") == F.col("src"), F.lit(0.0)).otherwise(bandwidth(F.col("ti"), F.col("tb"), tile))
    listed = F.array_sort(F.collect_list(F.struct(order("dest").alias("o1"), order("src").alias("o2"), "dest", "src", "ti", "tb", bw.alias("bw"))))
    near = lambda l: near_groups(F.transform(l, lambda x: x["bw"]), tolerance)
    one = links.agg(listed.alias("l"))
    each = one.select(F.explode(F.zip_with("l", near(F.col("l")), lambda x, v: F.struct(x["dest"].alias("dest"), x["src"].alias("src"), x["ti"].alias("ti"), x["tb"].alias("tb"), v.alias("bw")))).alias("x"))
    return each.select("x.*")


def partner(unit: Column) -> Column:
    """The unit that shares another's link to the host: 0 and 1, 2 and 3 and so on."""
    return unit.bitwiseXOR(F.lit(1))


def used(dest: Column, src: Column, workers: Column, holders: Column) -> Column:
    """Whether a link may carry anything: a worker at one end, a worker or holder of data at the other."""
    inside = lambda u, us: F.array_contains(us, u)
    either = (inside(dest, workers) & (inside(src, workers) | inside(src, holders))) | (inside(src, workers) & inside(dest, holders))
    return (dest != src) & either


def activated(edges: DataFrame, workers: list[int], holders: list[int]) -> DataFrame:
    """``active``: 2 to a worker, 1 to a unit that only holds data, -1 unused."""
    w, h = F.array(*map(F.lit, workers)), F.array(*map(F.lit, holders))
    on = used(F.col("dest"), F.col("src"), w, h)
    return edges.withColumn("active", F.when(on & F.array_contains(w, F.col("dest")), 2).when(on, 1).otherwise(-1))


def shared_links(weights: DataFrame, sets: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """``(set, dest, src, ti, tb, bw, active, share)`` of each set of ``(set, workers, holders)``.

    Of two partner links with the host the later one takes the earlier one's bandwidth, if that is in use;
    then near bandwidths into one unit are averaged. ``share`` is 2 where a link and its partner are both in use.
    Unused links have a null ``bw``.
    """
    dest, src = F.col("dest"), F.col("src")
    all_ = sets.crossJoin(F.broadcast(weights))
    on = used(dest, src, F.col("workers"), F.col("holders"))
    p_dest, p_src = F.when(src == -1, partner(dest)).otherwise(dest), F.when(dest == -1, partner(src)).otherwise(src)
    paired = (dest == -1) != (src == -1)
    state = all_.select("set", "dest", "src", "ti", "tb", "bw", on.alias("on"), F.when(on & F.array_contains("workers", dest), 2).when(on, 1).otherwise(-1).alias("active"), F.when(paired, p_dest).alias("pd"), F.when(paired, p_src).alias("ps"))
    mate = state.select(F.col("set").alias("_set"), dest.alias("_d"), src.alias("_s"), F.col("on").alias("_on"), F.col("bw").alias("_bw"))
    met = state.join(mate, (F.col("set") == F.col("_set")) & (F.col("pd") == F.col("_d")) & (F.col("ps") == F.col("_s")), "left")
    later = F.when(src == -1, F.col("pd") < dest).otherwise(F.col("ps") < src)
    both = F.coalesce(F.col("on") & F.col("_on"), F.lit(False))
    own = F.when(both & later, F.lit(None)).when(F.col("on"), F.col("bw"))
    row = met.select("set", "dest", "src", "ti", "tb", "active", own.alias("own"), (both & later).alias("follows"), "pd", "ps", F.when(both, 2.0).otherwise(1.0).alias("share"))
    order = F.when(src < 0, F.lit(1 << 30)).otherwise(src)
    lists = row.where("own IS NOT NULL").groupBy("set", "dest").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "src", "own"))).alias("l"))
    even = lists.select("set", "dest", F.explode(F.zip_with("l", running_near(F.transform("l", lambda x: x["own"]), tolerance), lambda x, v: F.struct(x["src"].alias("src"), v.alias("bw")))).alias("x")).select("set", "dest", "x.*")
    taken = even.select(F.col("set").alias("_set"), F.col("dest").alias("_d"), F.col("src").alias("_s"), "bw")
    at_dest, at_src = F.when(F.col("follows"), F.col("pd")).otherwise(dest), F.when(F.col("follows"), F.col("ps")).otherwise(src)
    out = row.withColumn("ad", at_dest).withColumn("as_", at_src).join(taken, (F.col("set") == F.col("_set")) & (F.col("ad") == F.col("_d")) & (F.col("as_") == F.col("_s")), "left")
    return out.select("set", "dest", "src", "ti", "tb", "bw", "active", "share")


def one_hop_routes(edges: DataFrame, penalty: float = 0.2) -> DataFrame:
    """``(dest, src, bw, routes)``: detours over one unit that beat the direct link, all ties kept."""
    e = edges.where("dest <> src").select("dest", "src", "bw")
    first = e.select(F.col("src").alias("src"), F.col("dest").alias("u"), F.col("bw").alias("b1"))
    second = e.select(F.col("src").alias("u"), F.col("dest").alias("dest"), F.col("bw").alias("b2"))
    via = first.join(second, "u").where("src <> dest").withColumn("hop", (1 - penalty) * F.least("b1", "b2"))
    better = via.join(e.withColumnRenamed("bw", "direct"), ["dest", "src"]).where(F.col("hop") > F.col("direct"))
    best = better.groupBy("dest", "src").agg(F.max("hop").alias("top"), F.collect_list(F.struct("hop", "u")).alias("all"))
    chosen = F.array_sort(F.transform(F.filter("all", lambda x: x["hop"] == F.col("top")), lambda x: x["u"]))
    routed = best.select("dest", "src", "top", chosen.alias("routes"))
    return e.join(routed, ["dest", "src"], "left").select("dest", "src", F.coalesce("top", "bw").alias("bw"), F.coalesce("routes", F.array().cast("array<int>")).alias("routes"))


def residual_slowdown(active: DataFrame, slowdowns: DataFrame, workers: list[int], holders: list[int], hopped: DataFrame | None = None, cap: float = 2.0) -> DataFrame:
    """``(dest, src, sl)``: what other links cost each active one that isn't replaced by a route, up to ``cap``; 1 without any.

    What counts are links that bring operands: from a holder of data to a worker, neither the link itself nor its partner
    (``p_dest``, ``p_src``), nor one that is ``hopped`` (``(dest, src)``), as nothing flows over that.
    """
    none = active.select("dest", "src").limit(0) if hopped is None else hopped.select("dest", "src")
    live = active.where("active > 0").join(none, ["dest", "src"], "left_anti")
    bringing = active.where((F.col("dest") != F.col("src")) & F.col("dest").isin(workers) & F.col("src").isin(holders)).join(none, ["dest", "src"], "left_anti")
    others = bringing.select(F.col("dest").alias("odest"), F.col("src").alias("osrc"))
    ends = live.select("dest", "src", "p_dest", "p_src")
    partner_ = (F.col("odest") == F.col("p_dest")) & (F.col("osrc") == F.col("p_src"))
    own = (F.col("odest") == F.col("dest")) & (F.col("osrc") == F.col("src"))
    hit = slowdowns.join(others, ["odest", "osrc"]).join(ends, ["dest", "src"]).where(~F.coalesce(partner_, F.lit(False)) & ~own).groupBy("dest", "src").agg(F.max("sl").alias("_sl"))
    return live.select("dest", "src").join(hit, ["dest", "src"], "left").select("dest", "src", F.least(F.lit(cap), F.greatest(F.lit(1.0), F.coalesce("_sl", F.lit(1.0)))).alias("sl"))


def causes_slowdown(active: DataFrame, slowdowns: DataFrame, least: float = 1.05) -> DataFrame:
    """Active links that slow another active link."""
    live = active.where("active > 0").select("dest", "src")
    victims = live.select(F.col("dest").alias("vd"), F.col("src").alias("vs"))
    bad = slowdowns.where(F.col("sl") > least).select(F.col("odest").alias("_d"), F.col("osrc").alias("_s"), F.col("dest").alias("vd"), F.col("src").alias("vs")).join(victims, ["vd", "vs"])
    return live.join(bad, (F.col("dest") == F.col("_d")) & (F.col("src") == F.col("_s")), "left_semi")


def routes_via(routes: DataFrame, unit: int) -> DataFrame:
    """Routes that end or pass at a unit."""
    return routes.where((F.col("dest") == unit) | (F.col("src") == unit) | F.array_contains("routes", unit))


def without_routes_via(routes: DataFrame, direct: DataFrame, unit: int) -> DataFrame:
    """``routes`` with every link that may pass at ``unit`` back on its direct link."""
    d = direct.select("dest", "src", F.col("bw").alias("_b"))
    ends = F.array_contains("routes", unit)
    return routes.join(d, ["dest", "src"]).select("dest", "src", F.when(ends, F.col("_b")).otherwise(F.col("bw")).alias("bw"), F.when(ends, F.array().cast("array<int>")).otherwise(F.col("routes")).alias("routes"))


def reset(edges: DataFrame) -> DataFrame:
    """The links as they are before anything is known of use: no shared bandwidth, nothing active, no routes."""
    return edges.select("dest", "src", "bw", F.lit(0.0).alias("bw_shared"), F.lit(-1).alias("active"), F.array().cast("array<int>").alias("routes"))


def load_stats(load: DataFrame) -> DataFrame:
    """Greatest, mean and variance of the links' times to completion, over all of them."""
    return load.agg(F.max("eta").alias("most"), F.avg("eta").alias("mean"), F.var_pop("eta").alias("variance"))


def link_load(transfers: DataFrame, edges: DataFrame) -> DataFrame:
    """``(dest, src, bytes, eta)``: what flows over each link, and seconds until it is through.

    ``transfers`` are ``(dest, src, bytes)``; links without any have an ETA of 0.
    """
    flow = transfers.groupBy("dest", "src").agg(F.sum("bytes").alias("bytes"))
    joined = edges.select("dest", "src", "bw").join(flow, ["dest", "src"], "left")
    size = F.coalesce("bytes", F.lit(0).cast("long"))
    return joined.select("dest", "src", size.alias("bytes"), F.try_divide(size, F.col("bw") * 1e9).alias("eta"))


def rebalanced(transfers: DataFrame, edges: DataFrame, rounds: int = 4, penalty: float = 0.2) -> DataFrame:
    """Transfers with detours ``via`` chosen by estimated time: a bounded driver loop.

    Each round takes the loads as they stand and moves every pair of ends to the detour
    whose two links are through soonest, if that is sooner than its own link by more than ``penalty``.
    The table of links is small; transfers are aggregated by ends, so they are too. Each round's
    outcome is written, so the trace is read once.
    """
    pairs = transfers.groupBy("dest", "src").agg(F.sum("bytes").alias("bytes")).where("dest <> src").withColumn("via", F.lit(None).cast("int"))
    pairs, edges = staged(pairs, "pairs"), staged(edges.select("dest", "src", "bw"), "edges")
    for _ in range(rounds):
        hops = pairs.select(F.explode(F.when(F.col("via").isNull(), F.array(F.struct("dest", "src", "bytes"))).otherwise(
            F.array(F.struct(F.col("via").alias("dest"), "src", "bytes"), F.struct("dest", F.col("via").alias("src"), "bytes")))).alias("h")).select("h.*")
        load = link_load(hops, edges.where("dest <> src"))
        first = load.select("src", F.col("dest").alias("u"), F.col("eta").alias("e1"))
        second = load.select(F.col("src").alias("u"), "dest", F.col("eta").alias("e2"))
        best = first.join(second, "u").where("src <> dest").groupBy("dest", "src").agg(F.min(F.struct(F.greatest("e1", "e2").alias("e"), "u")).alias("b"))
        direct = load.select("dest", "src", "eta")
        moved = pairs.join(direct, ["dest", "src"]).join(best, ["dest", "src"], "left")
        pairs = staged(moved.select("dest", "src", "bytes", F.when(F.col("via").isNull() & (F.col("b.e") < (1 - penalty) * F.col("eta")), F.col("b.u").cast("int")).otherwise(F.col("via")).alias("via")), "pairs")
    return pairs


def one_hop_paths(edges: DataFrame) -> DataFrame:
    """``(dest, src, via, links)``: each link as a path with a null ``via``, and each way over one unit between; ``links`` are its ``(dest, src)``."""
    e = edges.where("dest <> src AND bw > 0").select("dest", "src")
    direct = e.select("dest", "src", F.lit(None).cast("int").alias("via"), F.array(F.struct("dest", "src")).alias("links"))
    first, second = e.select(F.col("dest").alias("u"), "src"), e.select("dest", F.col("src").alias("u"))
    hops = F.array(F.struct(F.col("u").alias("dest"), "src"), F.struct("dest", F.col("u").alias("src")))
    return direct.unionByName(first.join(second, "u").where("src <> dest").select("dest", "src", F.col("u").cast("int").alias("via"), hops.alias("links")))


def balanced(transfers: DataFrame, edges: DataFrame, rounds: int = 12, tolerance: float = 1e-3, mean_weight: float = 1.0) -> tuple[DataFrame, list[float]]:
    """``(dest, src, bytes, via, share)``: how each pair's bytes are best split over its own link and detours; and the objective by round.

    The objective is the variance of the links' times to completion plus ``mean_weight`` times their squared mean, a convex
    quadratic of the flows. Each round sends every pair over the path of least marginal cost (of equal ones its own link, then the
    smallest ``via``) and goes as far towards that as the quadratic falls: it never rises. It ends when what a round could still win
    is under ``tolerance`` of it, or after ``rounds``. ``edges``: ``(dest, src, bw)``, those with a positive ``bw`` carry; a pair that
    no path joins has a null ``share``. Rows within a unit are left out. Transfers are added up once; what each round writes is a row
    a pair and a row a link, and one row of sums comes to the driver.
    """
    pairs = transfers.where("dest <> src AND bytes IS NOT NULL").groupBy("dest", "src").agg(F.sum("bytes").alias("bytes"))
    pairs, paths = staged(pairs, "pairs"), staged(one_hop_paths(edges), "paths")
    bw = staged(edges.where("dest <> src AND bw > 0").select("dest", "src", "bw"), "edges")
    first = F.min(F.struct(F.col("cost"), F.coalesce("via", F.lit(-(1 << 30))).alias("o"), "via", "links")).alias("b")
    own_first = F.when(F.col("via").isNull(), 0.0).otherwise(1.0)
    taken = lambda costs: staged(pairs.join(costs.groupBy("dest", "src").agg(first), ["dest", "src"]).select("dest", "src", "bytes", "b.via", "b.links"), "choice")

    def etas(choice: DataFrame) -> DataFrame:
        flow = choice.select("bytes", F.explode("links").alias("l")).groupBy("l.dest", "l.src").agg(F.sum("bytes").alias("f"))
        return bw.join(flow, ["dest", "src"], "left").select("dest", "src", "bw", (F.coalesce("f", F.lit(0)) / (F.col("bw") * 1e9)).alias("to"))

    choices = [taken(paths.withColumn("cost", own_first))]
    state = staged(etas(choices[0]).withColumnRenamed("to", "eta"), "etas")
    value = lambda var, mean: var + mean_weight * mean * mean
    now = state.agg(F.var_pop("eta").alias("v"), F.avg("eta").alias("m")).first()
    steps, objective = [], [value(now.v or 0.0, now.m or 0.0)]
    for _ in range(rounds if now.m else 0):
        marginal = state.select("dest", "src", ((F.col("eta") - (1 - mean_weight) * now.m) / F.col("bw")).alias("c"))
        each = paths.select("dest", "src", "via", "links", F.explode("links").alias("l"))
        met = each.join(marginal.select(F.col("dest").alias("_d"), F.col("src").alias("_s"), "c"), (F.col("l.dest") == F.col("_d")) & (F.col("l.src") == F.col("_s")))
        choice = taken(met.groupBy("dest", "src", "via", "links").agg(F.sum("c").alias("cost")))
        toward = staged(state.join(etas(choice).drop("bw"), ["dest", "src"]).withColumn("way", F.col("to") - F.col("eta")), "toward")
        x = toward.agg(F.covar_pop("eta", "way").alias("c"), F.var_pop("way").alias("v"), F.avg("way").alias("w")).first()
        slope, bend = x.c + mean_weight * now.m * x.w, value(x.v, x.w)
        if bend <= 0 or -2 * slope <= tolerance * objective[-1]:
            break
        step = min(1.0, -slope / bend)
        steps.append(step)
        choices.append(choice)
        state = toward.select("dest", "src", "bw", (F.col("eta") + step * F.col("way")).alias("eta"))
        now = state.agg(F.var_pop("eta").alias("v"), F.avg("eta").alias("m")).first()
        objective.append(value(now.v, now.m))
    weights, left = [], 1.0
    for step in reversed(steps):
        weights.insert(0, left * step)
        left *= 1 - step
    shares = None
    for w, choice in zip([left, *weights], choices):
        part = choice.select("dest", "src", "via", F.lit(w).alias("share"))
        shares = part if shares is None else shares.unionByName(part)
    shares = shares.groupBy("dest", "src", "via").agg(F.sum("share").alias("share")).where("share > 0")
    return pairs.join(shares, ["dest", "src"], "left").select("dest", "src", "bytes", "via", "share"), objective
