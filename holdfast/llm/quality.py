"""Operator 5 [native]. Quality rules: fixed limits, then robust multivariate outliers.

Texts that are too short or repeat too many of their words fail at once. Of the others a vector of
transformed statistics is judged: log length, smoothed log word length, and arcsine roots of the
shares of symbols, repeated lines and repeated words. Per language and source the minimum covariance
determinant gives a centre and a covariance that outliers do not move: from two robust starts,
concentration steps refit mean and covariance to the ``SUBSET`` of rows that lie nearest, the fit of
the smaller determinant wins, and a last refit uses all rows within its 97.5 % bound. A row beyond
the ``REJECT`` quantile of the squared Mahalanobis distance is rejected.

Groups with few rows are pooled by language, and what is left then as a whole; too few rows even then
reject nothing. Every pass reads a narrow table of statistics and returns sums per group. Medians
and subset limits are read from counts per cell of a fine grid, exact in rows, so no group is ever
collected or sorted, whatever share of the rows it holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import WHITE, staged, table, text_of, whole_row, words

MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words
WINDOW = 5
SYMBOLS = "#*$%&|<>"

STATS = ["x1", "x2", "x3", "x4", "x5"]
#: Least spread of each statistic; added to the variances, so constant statistics give no zeros.
SPREAD = [0.5, 0.05, 0.03, 0.15, 0.15]
SUBSET = 0.75
STEPS = 4
#: Rows a group needs for an estimate of its own.
GROUP_ROWS = 60
# Chi-square quantiles with five degrees of freedom, and consistency factors of trimmed covariances.
NEAR, REJECT = 12.833, 30.856  # 0.975 and 0.99999
SUBSET_FACTOR, NEAR_FACTOR = 1.412, 1.055
GRID = 256  # cells per unit


def _bound(expr: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.transform(F.array(expr), then)[0]


def repeated_words(w: Column) -> Column:
    """Number of words that lie in a window of five words found twice or more."""
    windows = F.when(F.size(w) >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)),
        lambda i: F.xxhash64(F.slice(w, i, WINDOW)))).otherwise(F.array().cast("array<long>"))

    def covered(g: Column) -> Column:
        placed = F.sort_array(F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = _bound(placed, lambda s: F.filter(s, lambda x, i: (
            F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        return _bound(places, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(
                F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)), F.lit(WINDOW))),
            F.lit(0), lambda a, b: a + b))

    return _bound(windows, lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g))
                  .otherwise(0)).cast("long")


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the counted statistics, ``base_failed`` and the transformed ones."""
    body = text_of(text)
    has_word = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = docs.withColumns({
        "_lines": _bound(has_word, lambda x: F.struct(
            F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))),
        "_words": _bound(words(F.col(text)), lambda w: F.struct(
            F.size(w).alias("n"), repeated_words(w).alias("repeat"))),
        "word_chars": F.length(F.translate(body, WHITE, "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
    }).withColumns({
        "n_words": F.col("_words.n").cast("long"), "n_lines": F.col("_lines.n").cast("long"),
        "n_dup_lines": F.col("_lines.dup").cast("long"),
        "n_repeat_words": F.col("_words.repeat"),
    }).drop("_lines", "_words")

    def share(part: str, whole: str, smooth: int) -> Column:
        return F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / (F.col(whole) + smooth))))

    return df.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS)
        | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
        "x1": F.log1p(F.col("n_words").cast("double")),
        "x2": F.log((F.col("word_chars") + 250) / (F.col("n_words") + 50)),
        "x3": share("n_symbols", "word_chars", 5), "x4": share("n_dup_lines", "n_lines", 2),
        "x5": share("n_repeat_words", "n_words", 20),
    })


def _groups(rows: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Per ``lang`` and ``source`` the group ``grp``: the pair, the language, or all; else null."""
    fit = rows.where("NOT base_failed").groupBy("lang", "source").count()
    small = F.when(F.col("count") < group_rows, F.col("count")).otherwise(0)
    counts = fit.withColumn("in_lang", F.sum(small).over(Window.partitionBy("lang")))
    rest = F.when((F.col("count") < group_rows) & (F.col("in_lang") < group_rows), F.col("count")) \
        .otherwise(0)
    counts = counts.withColumn("in_all", F.sum(rest).over(Window.partitionBy()))
    lang = F.coalesce(F.concat(F.lit("l"), F.col("lang")), F.lit("n"))
    source = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    grp = F.when(F.col("count") >= group_rows, F.xxhash64(F.lit("pair"), lang, source)) \
        .when(F.col("in_lang") >= group_rows, F.xxhash64(F.lit("lang"), lang)) \
        .when(F.col("in_all") >= group_rows, F.xxhash64(F.lit("all")))
    return counts.select(F.col("lang").alias("c_lang"), F.col("source").alias("c_source"),
                         grp.alias("grp"))


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Append what ``groups`` has for the row's language and source."""
    return rows.join(groups, F.col("lang").eqNullSafe(F.col("c_lang"))
                     & F.col("source").eqNullSafe(F.col("c_source")), "left") \
        .drop("c_lang", "c_source")


def _rank_cells(cells: DataFrame, by: list[str], share: float) -> DataFrame:
    """Per ``by``: the first cell up to which at least ``share`` of the rows lie (column ``cell``)."""
    counts = cells.groupBy(*by, "cell").count()
    run = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    return counts.withColumns({
        "upto": F.sum("count").over(run), "all": F.sum("count").over(whole),
    }).where(F.col("upto") >= F.ceil(F.col("all") * share)).groupBy(*by).agg(
        F.min("cell").alias("cell"))


def _medians(rows: DataFrame, centre: DataFrame | None) -> DataFrame:
    """Medians of the statistics per group, or of their distances from a centre: m1 to m5."""
    if centre is not None:
        rows = rows.join(centre, "grp").select("grp", *[
            F.abs(F.col(x) - F.col(f"m{i}")).alias(x) for i, x in enumerate(STATS, 1)])
    cells = rows.select("grp", F.posexplode(F.array(*STATS)).alias("stat", "x")).select(
        "grp", "stat", F.round(F.col("x") * GRID).cast("int").alias("cell"))
    found = _rank_cells(cells, ["grp", "stat"], 0.5)
    return found.groupBy("grp").agg(*[
        (F.max(F.when(F.col("stat") == i, F.col("cell"))) / GRID).alias(f"m{i + 1}")
        for i in range(len(STATS))])


def _distance(x: list[Column], m: list[Column], chol: dict[tuple[int, int], Column]) -> Column:
    """Squared Mahalanobis distance, by forward substitution with a Cholesky factor."""
    y: list[Column] = []
    for i in range(len(x)):
        known = reduce(lambda a, k: a - chol[i, k] * y[k], range(i), x[i] - m[i])
        y.append(known / chol[i, i])
    return reduce(lambda a, b: a + b, [v * v for v in y])


def _fitted(rows: DataFrame, factor: float) -> DataFrame:
    """Per group: mean m1.., Cholesky factor c11.. of the scaled covariance, and log determinant."""
    p = range(1, len(STATS) + 1)
    df = rows.groupBy("grp").agg(
        *[F.avg(f"x{i}").alias(f"m{i}") for i in p],
        *[F.covar_pop(f"x{i}", f"x{k}").alias(f"v{i}{k}") for i in p for k in p if k <= i])
    for i in p:
        for k in range(1, i + 1):
            left = F.col(f"v{i}{k}") * factor
            if i == k:
                left = left + SPREAD[i - 1] ** 2
            left = reduce(lambda a, j: a - F.col(f"c{i}{j}") * F.col(f"c{k}{j}"), range(1, k), left)
            df = df.withColumn(f"c{i}{k}", F.sqrt(F.greatest(left, F.lit(SPREAD[i - 1] ** 2)))
                               if i == k else left / F.col(f"c{k}{k}"))
    logdet = reduce(lambda a, b: a + b, [F.log(F.col(f"c{i}{i}")) for i in p])
    return df.withColumn("logdet", 2 * logdet).drop(*[f"v{i}{k}" for i in p for k in p if k <= i])


def _by_fit() -> Column:
    p = range(1, len(STATS) + 1)
    return _distance([F.col(f"x{i}") for i in p], [F.col(f"m{i}") for i in p],
                     {(i - 1, k - 1): F.col(f"c{i}{k}") for i in p for k in range(1, i + 1)})


def _nearest(rows: DataFrame) -> DataFrame:
    """The rows with the least ``d`` of each group, at least ``SUBSET`` of them, by cells of log d."""
    rows = rows.withColumn("cell", F.floor(F.log(F.col("d") + 1e-6) * GRID).cast("int"))
    # written, so that its size is known, and a hot group can be split if it is joined by a shuffle
    limit = staged(_rank_cells(rows.select("grp", "cell"), ["grp"], SUBSET), "mcd-subset")
    return rows.join(limit.withColumnRenamed("cell", "upto"), "grp").where("cell <= upto")


def estimates(rows: DataFrame) -> DataFrame:
    """Minimum covariance determinant estimate of each group of ``grp, x1..x5``."""
    own = rows.select("grp", *STATS)
    centre = staged(_medians(own, None), "mcd-medians")
    spread = _medians(own, centre).select("grp", *[
        F.greatest(1.4826 * F.col(f"m{i}"), F.lit(s)).alias(f"s{i}")
        for i, s in enumerate(SPREAD, 1)])
    robust = staged(centre.join(spread, "grp"), "mcd-spreads")
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"s{i}") for i, x in enumerate(STATS, 1)]
    scaled = own.join(robust, "grp").select("grp", *STATS, *[c.alias(f"z{i}")
                                                            for i, c in enumerate(z, 1)])
    zs = [F.col(f"z{i}") for i in range(1, len(STATS) + 1)]
    far = reduce(lambda a, b: a + b, [c * c for c in zs])
    most = reduce(F.greatest, [F.abs(c) for c in zs])
    fits = []
    # starts: nearest to the medians by the sum of squares, and by the largest single deviation
    for number, start in enumerate((far, most * most)):
        now = staged(_fitted(_nearest(scaled.withColumn("d", start)), SUBSET_FACTOR), "mcd-step")
        for _ in range(STEPS):
            now = staged(_fitted(_nearest(own.join(now, "grp").select(
                "grp", *STATS, _by_fit().alias("d"))), SUBSET_FACTOR), "mcd-step")
        fits.append(now.withColumn("start", F.lit(number)))
    both = fits[0].unionByName(fits[1])
    first = Window.partitionBy("grp").orderBy("logdet", "start")
    best = both.withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank")
    near = own.join(best, "grp").where(_by_fit() <= NEAR).select("grp", *STATS)
    return staged(_fitted(near, NEAR_FACTOR), "mcd-fits")


def fit_quality(statistics: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Limits for each language and source: the fit of its group, from a table of statistics."""
    groups = staged(_groups(statistics, group_rows), "quality-groups")
    rows = staged(_with_group(statistics.where("NOT base_failed"), groups)
                  .where("grp IS NOT NULL").select("grp", *STATS), "quality-fit")
    return staged(groups.join(estimates(rows), "grp", "left").drop("grp", "logdet", "start"),
                  "quality-limits")


def with_verdict(statistics: DataFrame, limits: DataFrame, reject: float = REJECT) -> DataFrame:
    """Append ``distance`` and ``kept``."""
    return _with_group(statistics, limits).withColumn("distance", _by_fit()).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= reject))


def _narrow(docs: DataFrame, key: str, text: str, lang: str, source: str) -> DataFrame:
    return staged(with_statistics(docs.select(
        docs[key].cast("long").alias("doc_id"), docs[lang].alias("lang"),
        docs[source].alias("source"), docs[text].alias("text"))).drop("text"),
        "quality-statistics")


def judge_quality(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
                  source: str = "source", group_rows: int = GROUP_ROWS,
                  reject: float = REJECT) -> DataFrame:
    """One row per document: doc_id, the counted statistics, base_failed, distance, kept.

    A language and source of ``group_rows`` rows or more that pass the base limits have their own
    estimate; ``reject`` is the least squared distance that rejects a row, not itself included.
    Null texts have no words and fail. Null languages and sources are groups of their own. Equal
    rows get equal verdicts; other columns are not read. An empty table gives no rows.
    """
    rows = _narrow(docs, key, text, lang, source)
    return with_verdict(rows, fit_quality(rows, group_rows), reject).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "distance")


def keep_good(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
              source: str = "source", group_rows: int = GROUP_ROWS,
              reject: float = REJECT) -> DataFrame:
    """The documents that pass, with all their columns.

    Statistics are counted again for the verdict, beside the text, so no text is shuffled.
    """
    limits = fit_quality(_narrow(docs, key, text, lang, source), group_rows)
    rows = docs.select(whole_row(docs.columns).alias("_row"),
                       docs[lang].alias("lang"), docs[source].alias("source"),
                       docs[text].alias("text"))
    return with_verdict(with_statistics(rows), limits, reject).where("kept").select("_row.*")


def op5_mcd_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return judge_quality(table(spark, sf_dir, "documents")).drop("distance")


QUERIES = {"op5_mcd_quality": op5_mcd_quality}
ORACLES: dict[str, str] = {}
