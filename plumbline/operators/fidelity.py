"""How far a table is from its source, by one ruler: bins and levels come from the source and are put to both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.stats import safe
from plumbline.operators.ranks import average_ranks, exact_quantiles

DECILES = [i / 10 for i in range(11)]
BANDS = [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
TOP_LEVELS = 20


def inner_edges(source: DataFrame, value: str, at: list[float]) -> Column:
    """Distinct quantiles of the source without the ends, as a literal array: a few numbers, whatever the table's size."""
    return F.array(*[F.lit(x) for x in sorted(set(exact_quantiles(source, value, at)))[1:-1]]).cast("array<double>")


def bin_of(c: Column, edges: Column) -> Column:
    """Number of edges at or below the value."""
    return F.when(c.isNotNull(), F.size(F.filter(edges, lambda e: e <= c.cast("double"))))


def _gap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Total variation distance of two tables of counts (keys, n)."""
    ta, tb = a.agg(F.sum("n").alias("ta")), b.agg(F.sum("n").alias("tb"))
    both = a.select(*keys, F.col("n").alias("na")).alias("a").join(b.select(*keys, F.col("n").alias("nb")).alias("b"), [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys], "full")
    shares = both.crossJoin(ta).crossJoin(tb)  # a row each
    p, q = safe(F.coalesce("na", F.lit(0)), F.col("ta")), safe(F.coalesce("nb", F.lit(0)), F.col("tb"))
    return shares.agg(F.count("*").alias("n_cells"), F.round(F.sum(F.abs(p - q)) / 2, 6).alias("tvd"))


def tvd_numeric(source: DataFrame, other: DataFrame, value: str) -> DataFrame:
    edges = inner_edges(source, value, DECILES)
    a, b = (d.where(F.col(value).isNotNull()).groupBy(bin_of(F.col(value), edges).alias("bin")).agg(F.count("*").alias("n")) for d in (source, other))
    return _gap(a, b, ["bin"])


def tvd_levels(source: DataFrame, other: DataFrame, level: str) -> DataFrame:
    """The source's commonest levels, and one for all others."""
    top = source.groupBy(F.coalesce(F.col(level).cast("string"), F.lit("null")).alias("l")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "l").limit(TOP_LEVELS).select("l")
    names = [r.l for r in top.collect()]  # TOP_LEVELS names at most
    kept = lambda c: F.when(c.isin(names), c).otherwise("other")
    a, b = (d.groupBy(kept(F.coalesce(F.col(level).cast("string"), F.lit("null"))).alias("level")).agg(F.count("*").alias("n")) for d in (source, other))
    return _gap(a, b, ["level"])


def tvd_pair(source: DataFrame, other: DataFrame, x: str, y: str) -> DataFrame:
    ex, ey = inner_edges(source, x, DECILES), inner_edges(source, y, DECILES)
    a, b = (d.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(bin_of(F.col(x), ex).alias("bx"), bin_of(F.col(y), ey).alias("by")).agg(F.count("*").alias("n")) for d in (source, other))
    return _gap(a, b, ["bx", "by"])


def ks(source: DataFrame, other: DataFrame, value: str) -> DataFrame:
    """Greatest distance of the two cumulative distributions.

    The rows of both at or below a value are its last rank in their union; those of the
    source alone are the last rank among weights, here had by ranking the source's rows
    and looking at its own values, just below and at them, where the distance is greatest.
    """
    both = source.select(F.col(value).alias("x"), F.lit(1).alias("s")).union(other.select(F.col(value).alias("x"), F.lit(0).alias("s"))).where("x is not null")
    counts = both.groupBy("x").agg(F.sum("s").alias("a"), F.count("*").alias("m"))
    last = lambda d, n: average_ranks(d, "x").select("x", (F.col("rank") + (F.col("n") - 1) / 2).alias(n))
    at = counts.where("a > 0").join(last(both, "every"), "x").join(last(source.select(F.col(value).alias("x")), "own"), "x")
    sizes = both.agg(F.sum("s").alias("na"), F.sum(1 - F.col("s")).alias("nb"))
    here = at.crossJoin(sizes)  # sizes: one row
    upto = F.abs(F.col("own") / F.col("na") - (F.col("every") - F.col("own")) / F.col("nb"))
    under = F.abs((F.col("own") - F.col("a")) / F.col("na") - (F.col("every") - F.col("own") - (F.col("m") - F.col("a"))) / F.col("nb"))
    # between two values of the source the other's share grows to what stands just below the next
    beyond = F.abs(1 - F.col("top") / F.col("nb"))
    ends = here.agg(F.first("na").alias("n_source"), F.first("nb").alias("n_other"), F.max(F.greatest(upto, under)).alias("d"), F.max(F.col("every") - F.col("own")).alias("top"), F.first("nb").alias("nb"))
    return ends.select("n_source", "n_other", F.round(F.greatest("d", beyond), 6).alias("ks"))


def marginal_bands(source: DataFrame, other: DataFrame, value: str) -> DataFrame:
    """Shares of both tables in the source's quantile bands."""
    edges = F.array(*[F.lit(x) for x in sorted(set(exact_quantiles(source, value, [*BANDS, 1.0])))]).cast("array<double>")
    band = lambda d, n: d.where(F.col(value).isNotNull()).groupBy(F.size(F.filter(edges, lambda e: e < F.col(value).cast("double"))).alias("band")).agg(F.count("*").alias(n))
    both = band(source, "n_source").join(band(other, "n_other"), "band", "full")
    total = both.agg(F.sum("n_source").alias("ts"), F.sum("n_other").alias("to"))
    return both.crossJoin(total).select("band", F.round(F.coalesce("n_source", F.lit(0)) / F.col("ts"), 6).alias("share_source"), F.round(F.coalesce("n_other", F.lit(0)) / F.col("to"), 6).alias("share_other"))  # total: one row


def cond_curve(df: DataFrame, entity: str, parent: str, child: str, bins: int = 12, k: int = 10) -> DataFrame:
    """Mean of a child over quantile bins of a parent, where enough rows and entities stand behind it."""
    both = df.where(F.col(parent).isNotNull() & F.col(child).isNotNull())
    edges = inner_edges(both, parent, [i / bins for i in range(bins + 1)])
    per = both.groupBy(bin_of(F.col(parent), edges).alias("bin")).agg(F.avg(parent).alias("x"), F.avg(child).alias("y"), F.count("*").alias("n"), F.stddev_samp(child).alias("sd"), F.count_distinct(entity).alias("entities"))
    return per.where((F.col("n") >= 5) & (F.col("entities") >= k)).select("bin", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n", F.round("sd", 6).alias("sd"), "entities")


def surface(df: DataFrame, entity: str, x: str, y: str, child: str, bins: int = 4, k: int = 10) -> DataFrame:
    """Mean of a child over a grid of two parents' quantile bins."""
    at = [i / bins for i in range(bins + 1)]
    ex, ey = inner_edges(df, x, at), inner_edges(df, y, at)
    per = df.groupBy(bin_of(F.col(x), ex).alias("bx"), bin_of(F.col(y), ey).alias("by")).agg(F.count("*").alias("n"), F.avg(child).alias("mean"), F.count_distinct(entity).alias("entities"))
    return per.where(F.col("entities") >= k).select("bx", "by", "n", F.round("mean", 6).alias("mean"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """Association of two level columns, without the bias correction."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    ra, cb = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    whole = cells.agg(F.sum("n").alias("t"), F.count_distinct("a").alias("r"), F.count_distinct("b").alias("c"))
    # chi squared over n = sum of n_ab^2 / (n_a n_b) - 1: cells that are empty add nothing
    q = cells.join(ra, "a").join(cb, "b").agg(F.sum(F.col("n") * F.col("n") / (F.col("na") * F.col("nb")).cast("double")).alias("q")).crossJoin(whole)
    v = F.sqrt(F.greatest(F.col("q") - 1, F.lit(0.0)) / (F.least("r", "c") - 1))
    return q.select(F.col("t").alias("n"), "r", "c", F.round(F.when((F.col("t") >= 30) & (F.col("r") > 1) & (F.col("c") > 1), v), 6).alias("v"))


def eta(df: DataFrame, level: str, value: str) -> DataFrame:
    """Share of a number's variance that a level explains, and its root."""
    per = df.where(F.col(level).isNotNull() & F.col(value).isNotNull()).groupBy(level).agg(F.count("*").alias("n"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("ss"))
    one = per.agg(F.sum("n").alias("n"), F.sum("ss").alias("ssw"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("nm2"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    between = F.col("nm2") - F.col("n") * F.col("mean") * F.col("mean")
    e2 = F.least(safe(between, between + F.col("ssw")), F.lit(1.0))
    return one.select("n", F.round(F.when(F.col("n") >= 20, e2), 6).alias("eta_squared"), F.round(F.when(F.col("n") >= 20, F.sqrt(e2)), 6).alias("eta"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation of average ranks of rows that have both."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    cells = both.groupBy("x", "y").agg(F.count("*").alias("c"))
    ranked = cells.join(average_ranks(both, "x").select("x", F.col("rank").alias("rx")), "x").join(average_ranks(both, "y").select("y", F.col("rank").alias("ry")), "y")
    w, rx, ry = F.col("c").cast("double"), F.col("rx"), F.col("ry")
    s = ranked.agg(F.sum("c").alias("n"), F.sum(w * rx).alias("sx"), F.sum(w * ry).alias("sy"), F.sum(w * rx * rx).alias("sxx"), F.sum(w * ry * ry).alias("syy"), F.sum(w * rx * ry).alias("sxy"))
    n = F.col("n").cast("double")
    rho = safe(F.col("sxy") - F.col("sx") * F.col("sy") / n, F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / n) * (F.col("syy") - F.col("sy") * F.col("sy") / n)))
    return s.select("n", F.round(rho, 6).alias("rho"))


def mutual_information(df: DataFrame, a: str, b: str, given: str | None = None) -> DataFrame:
    """In nats; within the strata of ``given`` if there is one."""
    keys = [F.col(a).alias("a"), F.col(b).alias("b"), (F.col(given) if given else F.lit(0)).alias("c")]
    cells = df.select(*keys).groupBy("a", "b", "c").agg(F.count("*").alias("n"))
    na, nb, nc = (cells.groupBy(*k).agg(F.sum("n").alias(m)) for k, m in ((["a", "c"], "na"), (["b", "c"], "nb"), (["c"], "nc")))
    total = cells.agg(F.sum("n").alias("t"))
    joined = cells.join(na, ["a", "c"]).join(nb, ["b", "c"]).join(nc, "c").crossJoin(total)  # total: one row
    return joined.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") / F.col("t").cast("double") * F.log(F.col("n") * F.col("nc") / (F.col("na") * F.col("nb")).cast("double"))), 6).alias("information"))


def orderings(df: DataFrame, columns: list[str], min_rows: int = 100) -> DataFrame:
    """Pairs a <= b that hold on every row that has both, in one pass, if they are of one size."""
    pairs = [(a, b) for a in columns for b in columns if a != b]
    made = []
    for a, b in pairs:
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        both = x.isNotNull() & y.isNotNull()
        made.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.when(both, 1)).alias("n"), F.bool_and(F.when(both, x <= y)).alias("holds"), F.min(F.when(both, y - x)).alias("gap"), F.least(F.stddev_pop(x), F.stddev_pop(y)).alias("sd")))
    one = df.agg(F.array(*made).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    return one.where((F.col("n") >= min_rows) & F.col("holds") & (F.col("gap") <= 2 * F.col("sd"))).select("a", "b", "n", F.round("gap", 6).alias("min_gap"))


def gate(pairs: DataFrame, direction: float = 0.939, close: float = 0.879, strong: float = 0.1) -> DataFrame:
    """Verdict on a table of pair statistics (source, other): signs kept, values close, none inverted."""
    s, g = F.col("source"), F.col("other")
    considered = pairs.where(F.abs(s) >= strong)
    one = considered.agg(F.count("*").alias("n_pairs"), F.avg((s * g > 0).cast("double")).alias("direction"), F.avg((F.abs(s - g) <= 0.2).cast("double")).alias("close"), F.count(F.when((s * g < 0) & (F.abs(g) >= strong), 1)).alias("inverted"))
    verdict = F.when(F.col("n_pairs") == 0, "NO_PAIRS").when((F.col("direction") >= direction) & (F.col("close") >= close) & (F.col("inverted") == 0), "PASS").otherwise("FAIL")
    return one.select("n_pairs", F.round("direction", 6).alias("direction"), F.round("close", 6).alias("close"), "inverted", verdict.alias("verdict"))
