"""Profiles of columns and entities: what a column is, how a number is shaped, how often people come, what repeats within a visit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.parse import tokens
from plumbline.functions.stats import safe
from plumbline.operators.ranks import exact_quantiles

K = 10
# Buckets of visits per person, and the fences of a number's body.
VISITS = [("1", 1, 1), ("2", 2, 2), ("3-5", 3, 5), ("6-10", 6, 10), ("11+", 11, None)]
FENCE = 2.5
SKEWED = 0.75
ZERO_INFLATED = 0.2


def visit_histogram(df: DataFrame, entity: str) -> DataFrame:
    """(visits, persons, share) by bucket of rows per person; buckets without anyone are there too."""
    per = df.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.count("*").alias("n"))
    counts = per.agg(F.count("*").alias("total"), *[F.count_if((F.col("n") >= low) & (F.col("n") <= high if high else F.lit(True))).alias(f"b{i}") for i, (_, low, high) in enumerate(VISITS)])
    rows = F.array(*[F.struct(F.lit(name).alias("visits"), F.col(f"b{i}").alias("persons")) for i, (name, _, _) in enumerate(VISITS)])
    return counts.select("total", F.explode(rows).alias("r")).select("r.visits", "r.persons", F.round(F.coalesce(safe(F.col("r.persons"), F.col("total")), F.lit(0.0)), 6).alias("share"))


def counted_quantiles(counts: DataFrame, value: str, n: str, at: list[float]) -> DataFrame:
    """(q, v): of values with their counts, the least whose running count reaches q of the total; a row a distinct value, as of a counter."""
    w = Window.orderBy(value)  # distinct whole numbers of a counter, a few thousand
    run = counts.withColumn("upto", F.sum(n).over(w)).crossJoin(counts.agg(F.sum(n).alias("total")))  # total: one row
    found = run.agg(*[F.min(F.when(F.col("upto") >= q * F.col("total"), F.col(value))).alias(f"q{i}") for i, q in enumerate(at)])
    rows = F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"q{i}").alias("v")) for i, q in enumerate(at)])
    return found.select(F.explode(rows).alias("r")).select("r.*")


def profile_numeric(df: DataFrame, value: str, k: int = K) -> DataFrame:
    """One row: the family that a number follows, fitted to its body, and what was left out of it.

    Where over a fifth are zeros, the body is the rest.  A positive, skewed body is
    lognormal and fenced in logarithms, another is normal; values beyond 2.5 quartile
    ranges are outliers, counted and not fitted.  No rows below k values.
    """
    x = df.select(F.col(value).cast("double").alias("x")).where("x is not null")
    one = x.agg(F.count("*").alias("n"), F.count_if(F.col("x") == 0).alias("zeros"), F.bool_and(F.col("x") == F.floor("x")).alias("whole"), F.skewness("x").alias("skew")).first()
    if one.n < k:
        return df.sparkSession.createDataFrame([], "family string, location double, scale double, outlier_rate double, zero_share double, integral boolean, skew double")
    inflated = one.zeros / one.n > ZERO_INFLATED and one.n - one.zeros >= k
    body = x.where("x <> 0") if inflated else x
    shape = body.agg(F.min("x").alias("low"), F.skewness("x").alias("skew")).first()
    log = shape.low > 0 and (shape.skew or 0) > SKEWED
    space = body.select(F.log("x").alias("y") if log else F.col("x").alias("y"))
    low, high = exact_quantiles(space, "y", [0.25, 0.75])
    inside = F.col("y").between(low - FENCE * (high - low), high + FENCE * (high - low)) if high > low else F.lit(True)
    fit = space.agg(F.count("*").alias("n"), F.count_if(inside).alias("kept"), F.avg(F.when(inside, F.col("y"))).alias("m"), F.stddev_samp(F.when(inside, F.col("y"))).alias("s"), F.avg("y").alias("m_all"), F.stddev_samp("y").alias("s_all"))
    some = F.col("kept") >= k
    return fit.select(
        F.lit("lognormal" if log else "normal").alias("family"), F.round(F.when(some, F.col("m")).otherwise(F.col("m_all")), 6).alias("location"), F.round(F.when(some, F.col("s")).otherwise(F.col("s_all")), 6).alias("scale"),
        F.round(F.when(some, (F.col("n") - F.col("kept")) / F.col("n")).otherwise(0.0), 6).alias("outlier_rate"), F.lit(round(one.zeros / one.n, 6)).alias("zero_share"), F.lit(one.whole).alias("integral"), F.round(F.lit(one["skew"]), 6).alias("skew"),
    )


def classify(df: DataFrame, columns: list[str], sep: str = ";") -> DataFrame:
    """(column_name, kind): what each text column is, by its values, all columns in one pass: empty, list, binary, identifier, numeric, date, constant or categorical."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "v").select("column_name", F.when(F.trim("v") != "", F.trim("v")).alias("v"))
    x = F.col("v").try_cast("double")
    s = long.groupBy("column_name").agg(
        F.count("v").alias("n"), F.count_distinct("v").alias("u"), F.count_if(F.contains("v", F.lit(sep))).alias("lists"), F.count(x).alias("numbers"), F.count_if(F.col("v").isin("0", "1")).alias("bits"),
        F.coalesce(F.bool_and(x == F.floor(x)), F.lit(False)).alias("whole"), F.min(x).alias("low"), F.count(F.to_date(F.try_to_timestamp(F.col("v")))).alias("dates"),
    )
    n, u = F.col("n"), F.col("u")
    numeric = F.when((u <= 2) & (F.col("bits") == n), "binary").when((u > F.greatest(F.lit(20.0), 0.5 * n)) & (n >= 20) & F.col("whole") & (F.col("low") > 10_000), "identifier").otherwise("numeric")
    text = F.when((n >= 20) & (u / n > 0.5), "identifier").when(u == 1, "constant").otherwise("categorical")
    kind = F.when(n == 0, "empty").when(F.col("lists") > 0, "list").when(F.col("numbers") == n, numeric).when(F.col("dates") > 0.9 * n, "date").otherwise(text)
    return s.select("column_name", kind.alias("kind"))


def within_visit(df: DataFrame, visit: str, concept: str, value: str) -> DataFrame:
    """Rows and visits, and of the visits those where a concept comes again and those where its value moves."""
    cells = df.where(F.col(visit).isNotNull()).groupBy(F.col(visit).alias("v"), F.col(concept).alias("c")).agg(F.count("*").alias("n"), F.count_distinct(value).alias("values"))
    per = cells.groupBy("v").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max("values").alias("values"))
    return per.agg(F.sum("n").alias("rows"), F.count("*").alias("visits"), F.count_if(F.col("most") >= 2).alias("visits_repeated"), F.count_if(F.col("values") >= 2).alias("visits_moving"))


def top_measures(df: DataFrame, visit: str, concept: str, value: str, n: int) -> DataFrame:
    """A row for each visit with the mean of the n commonest concepts, each a column ``m1`` to ``mn``, commonest first."""
    names = [r.c for r in df.where(F.col(concept).isNotNull()).groupBy(F.col(concept).alias("c")).agg(F.count("*").alias("k")).orderBy(F.desc("k"), "c").limit(n).collect()]
    return df.groupBy(visit).agg(*[F.round(F.avg(F.when(F.col(concept) == c, F.col(value))), 6).alias(f"m{i}") for i, c in enumerate(names, 1)])


def entropy(df: DataFrame, by: str, level: str) -> DataFrame:
    """(by, levels, entropy): in nats, of the levels within ``by``."""
    counts = df.where(F.col(level).isNotNull()).groupBy(by, level).agg(F.count("*").alias("n"))
    # sum of -p ln p from sums of n and n ln n alone
    total, mass = F.sum("n").cast("double"), F.sum(F.col("n") * F.log(F.col("n").cast("double")))
    return counts.groupBy(by).agg(F.count("*").alias("levels"), F.round(F.abs(F.log(total) - mass / total), 6).alias("entropy"))


def decay(df: DataFrame, entity: str, order: list[str], value: str, lags: int) -> DataFrame:
    """(lag, n_pairs, r, of_first): correlation with the row so many rows before, and as a share of that at one row."""
    w = Window.partitionBy(entity).orderBy(*order)
    x = F.col(value).cast("double")
    rows = df.select(x.alias("x"), *[F.lag(x, i).over(w).alias(f"p{i}") for i in range(1, lags + 1)])
    found = rows.agg(*[c for i in range(1, lags + 1) for c in (F.count_if(F.col("x").isNotNull() & F.col(f"p{i}").isNotNull()).alias(f"n{i}"), F.corr("x", f"p{i}").alias(f"r{i}"))])
    each = F.array(*[F.struct(F.lit(i).alias("lag"), F.col(f"n{i}").alias("n_pairs"), F.round(f"r{i}", 6).alias("r"), F.round(safe(F.col(f"r{i}"), F.col("r1")), 6).alias("of_first")) for i in range(1, lags + 1)])
    return found.select(F.explode(each).alias("r")).select("r.*")


def compare(one: DataFrame, two: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, coverage, mean and deviation of both): all columns of each table in one pass."""
    def side(df: DataFrame, name: str) -> DataFrame:
        long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column_name", "v")
        return long.groupBy("column_name").agg(F.round(F.avg(F.col("v").isNotNull().cast("double")), 6).alias(f"coverage_{name}"), F.round(F.avg("v"), 6).alias(f"mean_{name}"), F.round(F.stddev_samp("v"), 6).alias(f"sd_{name}"))

    return side(one, "source").join(side(two, "made"), "column_name")


def token_signal(df: DataFrame, column: str, numbers: list[str], sep: str = ";") -> DataFrame:
    """(token, signal, driver): each token's strongest correlation with a number, from sums; no row is repeated for tokens it lacks."""
    held = df.select(F.explode(F.array_distinct(tokens(F.col(column), sep))).alias("token"), *numbers)
    with_it = held.groupBy("token").agg(*[c for i, x in enumerate(numbers) for c in (F.count(x).alias(f"n1_{i}"), F.sum(F.col(x).cast("double")).alias(f"s1_{i}"))])
    whole = df.where(F.col(column).isNotNull()).agg(*[c for i, x in enumerate(numbers) for c in (F.count(x).alias(f"n_{i}"), F.sum(F.col(x).cast("double")).alias(f"s_{i}"), F.var_pop(F.col(x).cast("double")).alias(f"v_{i}"))])
    both = with_it.crossJoin(whole)  # whole: one row

    def phi(i: int) -> Column:
        n, n1 = F.col(f"n_{i}").cast("double"), F.col(f"n1_{i}").cast("double")
        share = n1 / n
        return F.abs(safe(F.col(f"s1_{i}") / n - share * F.col(f"s_{i}") / n, F.sqrt(share * (1 - share) * F.col(f"v_{i}"))))

    best = F.sort_array(F.array(*[F.struct(F.round(phi(i), 6).alias("signal"), F.lit(x).alias("driver")) for i, x in enumerate(numbers)]), False)[0]
    return both.select("token", best.alias("b")).select("token", "b.signal", "b.driver")


def publishable_sizes(column: Column, published: list[str], sep: str = ";") -> Column:
    """Published tokens in a set: 0 of an empty one, but 1 where all that it has falls below the floor; null stays null."""
    found = F.filter(F.transform(F.split(column, F.lit(sep)), lambda t: F.trim(t)), lambda t: t != "")
    kept = F.size(F.filter(found, lambda t: t.isin(published)))
    return F.when(column.isNotNull(), F.when(F.size(found) == 0, 0).when(kept == 0, 1).otherwise(kept))


def two_valued(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, low, high) of the numbers that have two values and no more."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column_name", "v").where("v is not null")
    ends = long.groupBy("column_name").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    others = long.join(ends, "column_name").groupBy("column_name", "low", "high").agg(F.count_if((F.col("v") != F.col("low")) & (F.col("v") != F.col("high"))).alias("others"))
    return others.where("others = 0 and low < high").select("column_name", "low", "high")


def tightness(df: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """(n, tightness): the share of a number's deviation that a straight fit on all parents takes away, from one pass of sums."""
    import numpy as np

    names = [*parents, child]
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names]).dropna()
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1)]
    one = rows.agg(F.count("*").alias("n"), *[F.covar_pop(names[i], names[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    if not one.n:
        return df.sparkSession.createDataFrame([(0, None)], "n long, tightness double")
    c = np.zeros((len(names), len(names)))
    for i, j in pairs:
        c[i, j] = c[j, i] = one[f"c{i}_{j}"]
    solved = np.linalg.lstsq(c[:-1, :-1], c[:-1, -1], rcond=None)[0]
    left, whole = max(float(c[-1, -1] - solved @ c[:-1, -1]), 0.0), float(c[-1, -1])
    return df.sparkSession.createDataFrame([(one.n, round(1 - (left / whole) ** 0.5, 6) if whole > 0 else None)], "n long, tightness double")
