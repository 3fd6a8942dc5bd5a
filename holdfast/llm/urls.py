"""Operator 9 [native]. URL filter: rules first, then boosted trees on lexical features.

Features are column expressions: lengths, depth, digit ratio, entropy, parameter counts, and how
often labelled URLs with the same suffix, first directory or host name part were blocked. URLs that
the trees are fitted on get these shares from other folds of URLs, so not from their own label. The
trees are Spark ML's. Labels come with a table of labelled URLs; without one, from the rules and from
a list of words that bad host names hold, and URLs without a label count as allowed with a low
weight, so that the trees see ordinary hosts too.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.common import staged, table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
#: Words in host names that label a URL as one to block.
BAD_WORDS = ("adult", "ads", "casino", "malware", "phish", "pills", "porn", "spam", "viagra")
#: Weight of a URL without label, which counts as allowed.
UNLABELLED = 0.25
#: Distinct URLs that the trees are fitted on at most, picked by their hashes from each kind of label.
#: The suffix statistics count all URLs.
TRAINING_ROWS = 20_000
TREES, DEPTH, SEED = 20, 4, 7
#: Strength of the overall block rate in the suffix statistics, in labelled URLs.
PRIOR = 20.0
#: Folds of URLs whose labels are left out of the statistics they are fitted with.
FOLDS = 5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUMBERS = ["url_chars", "host_chars", "path_chars", "query_chars", "depth", "host_parts",
           "n_params", "digit_ratio", "mark_ratio", "host_digit_ratio", "hyphens", "entropy",
           "host_entropy", "longest_part", "has_fragment", "encoded"]
#: Suffix statistics: share of blocked labelled URLs with the same value.
SUFFIXES = ["suffix", "site", "name", "directory", "ending"]


def host_path(url: Column) -> tuple[Column, Column]:
    """Host in lower case (A-Z) and path; both empty without ``://`` and for null."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def with_rule(df: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Append ``rule`` and ``ruling`` of the longest rule that fits; null where none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    rule = ruling = F.lit(None).cast("string")
    for verdict, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, path = text.partition("/")
        fits = ((F.col("host") == name) | F.col("host").endswith("." + name)) \
            & F.col("path").startswith("/" + path)
        rule = F.when(fits, text).otherwise(rule)
        ruling = F.when(fits, verdict).otherwise(ruling)
    return df.withColumns({"rule": rule, "ruling": ruling})


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text)
    chars = F.array_distinct(F.split(text, ""))
    total = F.aggregate(chars, F.lit(0.0), lambda acc, c: acc + F.when(c == "", 0.0).otherwise(
        (size - F.length(F.replace(text, c, F.lit("")))).cast("double")
        * F.log2(F.greatest(size - F.length(F.replace(text, c, F.lit(""))), F.lit(1)))))
    return F.when(size > 0, F.log2(size.cast("double")) - total / size).otherwise(0.0)


def _ratio(text: Column, pattern: str) -> Column:
    return F.when(F.length(text) > 0,
                  F.regexp_count(text, F.lit(pattern)) / F.length(text)).otherwise(0.0)


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Append host, path, lexical numbers and suffix keys. A null URL counts as an empty one."""
    host, path = host_path(F.col(url))
    df = df.withColumns({"host": host, "path": path, "_u": F.coalesce(F.col(url), F.lit(""))})
    u, h, p = F.col("_u"), F.col("host"), F.col("path")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    parts = F.split(h, r"\.")
    out = {
        "url_chars": F.length(u), "host_chars": F.length(h), "path_chars": F.length(p),
        "query_chars": F.length(query), "depth": F.regexp_count(p, F.lit("/[^/]")),
        "host_parts": F.regexp_count(h, F.lit(r"[^.]+")),
        "n_params": F.regexp_count(query, F.lit(r"[^&;]+")),
        "digit_ratio": _ratio(u, "[0-9]"), "mark_ratio": _ratio(u, r"[^0-9A-Za-z/:.]"),
        "host_digit_ratio": _ratio(h, "[0-9]"), "hyphens": F.regexp_count(h, F.lit("-")),
        "entropy": _entropy(u), "host_entropy": _entropy(h),
        "longest_part": F.array_max(F.transform(F.split(F.concat(h, p), r"[./]"), F.length)),
        "has_fragment": u.contains("#").cast("int"), "encoded": F.regexp_count(u, F.lit("%")),
    }
    keys = {
        "suffix": F.element_at(parts, -1),
        "site": F.concat_ws(".", F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)),
        "name": F.coalesce(F.get(parts, F.size(parts) - 3), F.lit("")),
        "directory": F.regexp_extract(p, r"^/([^/]*)/", 1),
        "ending": F.regexp_extract(p, r"\.([^./]*)$", 1),
    }
    return df.withColumns({k: v.cast("double") for k, v in out.items()} | keys).drop("_u")


def fold_of(url: Column) -> Column:
    return F.pmod(F.xxhash64(url, F.lit("fold")), F.lit(FOLDS)).cast("int")


def suffix_rates(labelled: DataFrame) -> DataFrame:
    """Per kind and value of a suffix: ``rate``, the smoothed share of blocked URLs, and ``others``.

    ``others`` holds for each fold of URLs the same share over the other folds; null where no other
    fold has the value.
    """
    pairs = labelled.select(fold_of(F.col("url")).alias("fold"), "blocked", "weight", F.explode(
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in SUFFIXES]))
        .alias("s"))
    mean = labelled.agg(F.sum(F.col("blocked") * F.col("weight")) / F.sum("weight")).first()[0]
    prior = F.lit(PRIOR * (mean or 0.0))
    bad = F.col("blocked") * F.col("weight")

    def apart(i: int) -> Column:
        other = F.col("fold") != i
        return F.when(F.sum(F.when(other, F.col("weight"))) > 0, (
            F.sum(F.when(other, bad)) + prior) / (F.sum(F.when(other, F.col("weight"))) + PRIOR))

    return pairs.groupBy("s.kind", "s.value").agg(
        ((F.sum(bad) + prior) / (F.sum("weight") + PRIOR)).alias("rate"),
        F.array(*[apart(i) for i in range(FOLDS)]).alias("others"))


def with_rates(df: DataFrame, rates: DataFrame, fitting: bool = False) -> DataFrame:
    """Append ``<kind>_rate``; values that no labelled URL has get -1.

    Rows that a model is fitted on (``fitting``) get the rates of the other folds, which do not hold
    their own label, nor that of any URL they share the fold with.
    """
    for kind in SUFFIXES:
        rate = F.get("others", fold_of(F.col("url"))) if fitting else F.col("rate")
        own = rates.where(F.col("kind") == kind).select(F.col("value").alias(kind), "rate", "others")
        df = df.join(own, kind, "left").withColumn(
            f"{kind}_rate", F.coalesce(rate, F.lit(-1.0))).drop("rate", "others")
    return df


_ASSEMBLER = {"inputCols": NUMBERS + [f"{k}_rate" for k in SUFFIXES], "outputCol": "features"}


def fit_urls(labelled: DataFrame, trees: int = TREES, sample: DataFrame | None = None,
             ) -> tuple[DataFrame, GBTClassificationModel]:
    """Suffix rates and trees of labelled rows: ``lexical`` columns, ``blocked`` 0 or 1, ``weight``.

    With ``sample`` the trees are fitted on its rows, the rates still count all labelled ones. Rows
    that are fitted see the rates of the other folds.
    """
    rates = staged(suffix_rates(labelled), "url-rates")
    rows = VectorAssembler(**_ASSEMBLER).transform(
        with_rates(labelled if sample is None else sample, rates, fitting=True))
    model = GBTClassifier(labelCol="blocked", maxIter=trees, maxDepth=DEPTH, seed=SEED,
                          weightCol="weight").fit(rows.select("blocked", "weight", "features"))
    return rates, model


def labels(rows: DataFrame, words: tuple = BAD_WORDS, unlabelled: float = UNLABELLED) -> DataFrame:
    """Append ``blocked`` and ``weight``: by bad words in the host name, else by the rules."""
    bad = F.col("host").rlike(r"(^|[.-])(" + "|".join(words) + r")([.-]|$)")
    return rows.withColumns({
        "blocked": F.when(bad | (F.coalesce("ruling", F.lit("")) == "block"), 1.0).otherwise(0.0),
        "weight": F.when(bad | F.col("ruling").isNotNull(), 1.0).otherwise(unlabelled),
    })


def training_sample(once: DataFrame, kinds: dict[int, int],
                    rows: int = TRAINING_ROWS) -> DataFrame:
    """At most ``rows`` URLs, as many of each ``kind`` as there are or fit.

    ``kinds`` counts the rows of each kind. Weights grow by the share that is left out, so a kind
    weighs what it does in the whole table. Only rows whose hash lies below a share with room for
    ten deviations are ordered, about ``rows`` in all, however many there are.
    """
    if sum(kinds.values()) <= rows:
        return once
    picked, room = None, rows
    for at, (kind, n) in enumerate(sorted(kinds.items(), key=lambda k: (k[1], k[0]))):
        quota = min(n, max(1, room // (len(kinds) - at)))
        room -= quota
        own = once.where(F.col("kind") == kind)
        if quota < n:
            draw = F.xxhash64("url", F.lit(SEED))
            least = (quota + 10 * quota ** 0.5 + 50) / n
            own = own.where(draw <= F.lit(int((min(least, 1.0) - 0.5) * (2 ** 64 - 2 ** 11)))).orderBy(
                draw, "url").limit(quota).withColumn("weight", F.col("weight") * (n / quota))
        picked = own if picked is None else picked.unionByName(own)
    return picked


def from_labels(labelled: DataFrame) -> DataFrame:
    """Distinct URLs with ``blocked`` and ``weight`` from rows (url, blocked, weight).

    Weights of one URL are added up and its heavier label counts; ties are blocked. Rows without a
    weight above 0 or without a label do not count. A null URL counts as an empty one.
    """
    w, bad = F.col("weight").cast("double"), F.col("blocked").cast("double")
    return labelled.select(F.coalesce("url", F.lit("")).alias("url"), w.alias("w"), bad.alias("bad"))         .where("w > 0 AND NOT isnan(w) AND bad IS NOT NULL").groupBy("url").agg(
        F.sum(F.when(F.col("bad") > 0, F.col("w")).otherwise(-F.col("w"))).alias("lead"),
        F.sum("w").alias("weight")).select(
        "url", (F.col("lead") >= 0).cast("double").alias("blocked"), "weight")


def judge_urls(pages: DataFrame, rules: tuple = RULES, url: str = "url", key: str = "page_id",
               training_rows: int = TRAINING_ROWS, labelled: DataFrame | None = None) -> DataFrame:
    """Host, path, rule and verdict of every URL, with the trees' probability of blocking.

    ``labelled`` (``url``, ``blocked``, ``weight``) are the URLs to learn from, in ``pages`` or not;
    without it the labels are those of ``labels``. Null and odd URLs have an empty host and path and
    are judged by the trees like others. Where all labels are equal, or there are no rows, nothing
    can be learned: URLs without a rule are allowed. Equal rows are all kept; other columns are not
    read.
    """
    rows = staged(with_rule(lexical(pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"))), rules), "urls")
    # one row per URL, so that a URL that many pages share counts once
    once = labels(rows).drop("page_id", "rule", "ruling").dropDuplicates(["url"])         if labelled is None else lexical(from_labels(labelled))
    # labels of rules and words weigh 1, the lack of one less
    once = staged(once.withColumn("kind", F.expr("int(blocked) * 2 + int(weight < 1)")), "url-once")
    kinds = {r[0]: r[1] for r in once.groupBy("kind").count().collect()}
    if len({kind >= 2 for kind in kinds}) < 2:
        return rows.select("page_id", "host", "path", "rule",
                           F.coalesce("ruling", F.lit("allow")).alias("verdict"),
                           F.lit(None).cast("double").alias("p_block"))
    sample = training_sample(once, kinds, training_rows)
    rates, model = fit_urls(once, sample=None if sample is once else staged(sample, "url-sample"))
    scored = model.transform(VectorAssembler(**_ASSEMBLER).transform(with_rates(rows, rates)))
    p = vector_to_array("probability")[1]
    return scored.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruling", F.when(p > 0.5, "block").otherwise("allow")).alias("verdict"),
        p.alias("p_block"))


def op9_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every URL of ``pages``."""
    return judge_urls(table(spark, sf_dir, "pages")).drop("p_block")


QUERIES = {"op9_url_trees": op9_url_trees}
ORACLES: dict[str, str] = {}
