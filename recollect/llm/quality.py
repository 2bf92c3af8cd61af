"""Quality rules: text statistics and robust multivariate outliers, in DataFrame functions alone.

Each text becomes a vector of four transformed statistics. For each language and source a minimum covariance
determinant estimate is made by concentration steps: distances under the present estimate, the share H of rows
with the least distances, mean and covariance of those, again. The cut between the nearest rows and the rest is
found on a histogram of distances, so no group is sorted or collected in one task: a group may hold any share of
the rows. Steps are repeated until the determinants stay, or come back. Of two starts the one with the smaller determinant stays, is reweighted, and rejects by squared
Mahalanobis distance.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.llm.shared import WORD, bounded_join, fits, written

SYMBOLS = r"[#*$%&|<>]"
#: Share of rows that a concentration step keeps, and the smallest group with an own estimate.
H, LEAST_ROWS = 0.75, 60
#: Steps go on until the determinants are what they have been before (whole bins of the histogram may let the cut swing between
#: two estimates), but not beyond so many.
STEPS = 20
#: Least standard deviation of each statistic: log word length, log symbol rate, log line-repeat rate, repeat angle.
FLOORS = (0.08, 0.30, 0.30, 0.15)
#: Chance that a Gaussian vector is rejected.
TAIL = 1e-6
#: More groups than this are joined by sort-merge and not broadcast.
BROADCAST_GROUPS = 50_000
P = len(FLOORS)


def chi2_cdf(x: float, dof: int) -> float:
    """Of an even number of degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(q: float, dof: int) -> float:
    low, high = 0.0, 500.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < q else (low, mid)
    return high


CUTOFF = chi2_quantile(1 - TAIL, P)
#: What makes a covariance of the nearest share of Gaussian rows consistent.
CONSISTENT = H / chi2_cdf(chi2_quantile(H, P), P + 2)
REWEIGHT = chi2_quantile(0.975, P)
CONSISTENT_REWEIGHT = 0.975 / chi2_cdf(REWEIGHT, P + 2)


def repeat_words(words: Column, n: Column) -> Column:
    """Words inside 3-word windows that occur twice or more (windows are compared by 64-bit hash)."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    size = F.greatest(n - 2, F.lit(0)).cast("int")
    pairs = F.zip_with(F.slice(hashes, F.lit(2), size), F.slice(hashes, F.lit(3), size), lambda a, b: F.xxhash64(a, b))
    triples = F.zip_with(F.slice(hashes, F.lit(1), size), pairs, lambda a, b: F.xxhash64(a, b))
    return F.sort_array(F.transform(triples, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))


def text_statistics(docs: DataFrame, text_col: str = "text", columns: list[str] | None = None, group: list[Column] | None = None) -> DataFrame:
    """(row struct of the columns named, group struct, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), a row
    for each row.

    Null and empty texts have no words, and every count is 0.
    """
    text = F.coalesce(F.col("__text"), F.lit(""))
    last = lambda c: F.greatest(F.size(c) - 1, F.lit(0))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns or docs.columns]).alias("row"), F.struct(*(group or [F.lit(0).alias("lang")])).alias("group"), F.col(text_col).alias("__text"))
    out = out.withColumn("__words", F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)))
    out = out.withColumn("n_words", F.size("__words").cast("long"))
    out = out.withColumn("__triples", repeat_words(F.col("__words"), F.col("n_words")))
    out = out.withColumn("__lines", F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.select(
        "row",
        "group",
        "n_words",
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.zip_with(F.slice("__triples", F.lit(1), last("__triples")), F.slice("__triples", F.lit(2), last("__triples")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"]))).alias("__twice"),
    )
    out = out.withColumn("__at", F.sort_array(F.array_distinct(F.flatten(F.filter("__twice", lambda x: x.isNotNull())))))
    gaps = F.zip_with("__at", F.slice("__at", F.lit(2), last("__at")), lambda a, b: F.least(b - a, F.lit(3)))
    return out.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda s, x: s + x)).drop("__twice", "__at")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The transformed statistics, of rows that have words."""
    chars, words = F.col("word_chars").cast("double"), F.col("n_words").cast("double")
    return [
        F.log(chars / words),
        F.log1p(100 * F.col("n_symbols") / chars),
        F.log1p(100 * F.col("n_dup_lines") / words),
        F.asin(F.sqrt(F.col("n_repeat_words") / words)),
    ]


def with_cells(rows: DataFrame, lang: Column, source: Column) -> tuple[DataFrame, DataFrame]:
    """Add the cell whose estimate judges a row: its language and source; if that has too few rows, its whole language; else
    all rows; null only where the whole table has too few. Null languages and sources are values.

    Also (__key, cell) for each language and source and each cell that judges some row and whose estimate it takes part in:
    large cells take part in the estimates of their language and of all, too, where a small cell needs those.
    """
    fine, coarse = F.to_json(F.struct(lang.alias("lang"), source.alias("source"))), F.to_json(F.struct(lang.alias("lang")))
    rows = rows.withColumns({"__fine": fine, "__coarse": coarse})
    counts = rows.where("not base_failed").groupBy("__fine", "__coarse").agg(F.count("*").alias("n"))
    by_lang = written(counts.groupBy("__coarse").agg(F.sum("n").alias("n2")).withColumnRenamed("__coarse", "__lang"), "quality-languages")
    total = by_lang.agg(F.coalesce(F.sum("n2"), F.lit(0)).alias("n3"))
    counts = bounded_join(counts, by_lang, F.col("__coarse") == F.col("__lang"), "left", BROADCAST_GROUPS).crossJoin(F.broadcast(total))  # one row
    own, whole, every = F.concat(F.lit("1"), F.col("__fine")), F.concat(F.lit("2"), F.col("__coarse")), F.lit("3")
    cell = F.when(F.col("n") >= LEAST_ROWS, own).when(F.col("n2") >= LEAST_ROWS, whole).when(F.col("n3") >= LEAST_ROWS, every)
    cells = written(counts.select(F.col("__fine").alias("__key"), whole.alias("whole"), cell.alias("cell")), "quality-cells")
    out = bounded_join(rows, cells.drop("whole"), F.col("__fine") == F.col("__key"), "left", BROADCAST_GROUPS).drop("__coarse", "__key")
    used = cells.where("cell is not null").select("cell").distinct()
    levels = cells.select("__key", F.explode(F.array(F.concat(F.lit("1"), F.col("__key")), F.col("whole"), every)).alias("__cell"))
    members = bounded_join(levels, used, F.col("__cell") == F.col("cell"), "inner", BROADCAST_GROUPS).select("__key", "cell")
    return out, written(members, "quality-members")


def estimates(rows: DataFrame, keys: list[str], factor: float) -> DataFrame:
    """Mean, Cholesky factor and log determinant of the covariance (with floors) of each group of rows."""
    xs = [f"x{i}" for i in range(P)]
    moments = [F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)] + [F.covar_pop(xs[i], xs[j]).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *moments)
    out = out.withColumns({f"c{i}{j}": F.col(f"c{i}{j}") * factor + (FLOORS[i] ** 2 if i == j else 0.0) for i in range(P) for j in range(i + 1)})
    for j in range(P):
        out = out.withColumn(f"l{j}{j}", F.sqrt(F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))))
        out = out.withColumns({f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, P)})
    out = out.withColumn("logdet", sum((2 * F.log(F.col(f"l{j}{j}")) for j in range(P)), F.lit(0.0)))
    return out.select(*keys, "n", "logdet", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)])


def with_groups(rows: DataFrame, right: DataFrame, on, how: str, few: bool | None) -> DataFrame:
    """Join a row for each group: broadcast if the groups are few (None: count them), else sort-merge."""
    if few is None:
        return bounded_join(rows, right, on, how, 2 * BROADCAST_GROUPS)
    return rows.join(F.broadcast(right) if few else right.hint("merge"), on, how)


def with_distance(rows: DataFrame, found: DataFrame, keys: list[str], few: bool | None = None) -> DataFrame:
    """Add the squared Mahalanobis distance under the group's estimate."""
    right = found.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in found.columns if c[0] in "ml" and c != "logdet"])
    on = [F.col(k) == F.col(f"__{k}") for k in keys]
    out = with_groups(rows, right, on, "left", few)
    for i in range(P):
        out = out.withColumn(f"z{i}", (F.col(f"x{i}") - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    out = out.withColumn("d2", F.round(sum((F.col(f"z{i}") ** 2 for i in range(P)), F.lit(0.0)), 6))
    return out.drop(*right.columns, *[f"z{i}" for i in range(P)])


def nearest(rows: DataFrame, keys: list[str], share: float, few: bool | None = None) -> DataFrame:
    """The rows up to the histogram bin that completes the share with the least distances."""
    rows = rows.withColumn("bin", F.floor(32 * F.log2(1 + F.col("d2"))))
    bins = rows.groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    total, up_to = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("bin")
    cut = bins.withColumns({"all": F.sum("n").over(total), "cum": F.sum("n").over(up_to)}).where(F.col("cum") >= share * F.col("all")).groupBy(*keys).agg(F.min("bin").alias("cut"))
    cut = written(cut.select(*[F.col(k).alias(f"__{k}") for k in keys], "cut"), "quality-cut")
    out = with_groups(rows, cut, [F.col(k) == F.col(f"__{k}") for k in keys], "inner", few)
    return out.where(F.col("bin") <= F.col("cut")).drop(*cut.columns, "bin", "d2")


def covariance_determinants(rows: DataFrame) -> DataFrame:
    """Minimum covariance determinant estimate of each cell of (cell, x0..x3)."""
    starts = ["cell", "start"]
    few = fits(rows.select("cell").distinct(), BROADCAST_GROUPS)  # so 2 x BROADCAST_GROUPS rows at most are sent
    both = rows.select("cell", *[f"x{i}" for i in range(P)], F.explode(F.array(F.lit(0), F.lit(1))).alias("start"))
    # Start 0: all rows. Start 1: the rows with the least sum of squares, as statistics of clean text are near 0.
    least = F.when(F.col("start") == 0, F.lit(0.0)).otherwise(sum((F.col(f"x{i}") ** 2 / FLOORS[i] ** 2 for i in range(1, P)), F.lit(0.0)))
    found = written(estimates(nearest(both.withColumn("d2", F.round(least, 6)), starts, 0.5, few), starts, 1.0), "quality-start")
    before: set = set()
    for _ in range(STEPS):
        now = found.agg(F.sum(F.round("logdet", 6).cast("decimal(38,6)"))).first()[0]
        if now in before:
            break
        before.add(now)
        found = written(estimates(nearest(with_distance(both, found, starts, few), starts, H, few), starts, CONSISTENT), "quality-step")
    best = found.groupBy("cell").agg(F.min(F.struct("logdet", "start", *[c for c in found.columns if c[0] in "ml" and c != "logdet"])).alias("b")).select("cell", "b.*")
    best = written(best, "quality-best")
    near = with_distance(rows.select("cell", *[f"x{i}" for i in range(P)]), best, ["cell"], few).where(F.col("d2") <= REWEIGHT)
    return written(estimates(near, ["cell"], CONSISTENT_REWEIGHT), "quality-estimates")


def quality(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Judge every row: (row struct, the five counts, base_failed, distance, kept), a row for each row.

    `row` holds the columns named (all by default), so names can't clash. Rows that fail the base rules aren't kept
    and have no distance. Cells of fewer than LEAST_ROWS rows are judged by the estimate of their whole language, or of all
    rows (see with_cells); only where the whole table is too small the base rules alone decide. Null text: no words, so
    base_failed. Repeated rows are judged alike.
    """
    columns = columns or docs.columns
    rows = text_statistics(docs, text_col, columns, [F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source")])
    rows = rows.withColumn("base_failed", base_failed())
    rows = written(rows.withColumns({f"x{i}": F.when(~F.col("base_failed"), x) for i, x in enumerate(vector())}), "quality-statistics")
    rows, members = with_cells(rows, F.col("group.lang"), F.col("group.source"))
    good = rows.where("not base_failed").select("__fine", *[f"x{i}" for i in range(P)])
    found = covariance_determinants(bounded_join(good, members, F.col("__fine") == F.col("__key"), "inner", 3 * BROADCAST_GROUPS).drop("__fine", "__key"))
    out = with_distance(rows, found, ["cell"]).drop(*[f"x{i}" for i in range(P)], "cell", "group", "__fine")
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= CUTOFF, F.lit(True))
    return out.withColumn("kept", kept).withColumnRenamed("d2", "distance")
