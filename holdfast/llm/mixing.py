"""Operator 4 [native]. Mixing sources to target weights by a hypergeometric splitting tree.

Every source is laid out as one line of words, its documents in hashed order, and cut into at most
``BLOCKS`` blocks of equal words. A source's target is drawn in passes: whole passes take all
blocks, the last one the blocks that come first in a hashed permutation, the last of them in part,
so that a source gives exactly its target in whole words. Drawn blocks are dealt to output shards
by a tree: each node splits its quota vector (blocks per source and pass) between its halves by a
multivariate hypergeometric draw, so shards are equal in blocks and random in composition. Blocks of
a source are disjoint, and go to shards in the order of the permutation; inside a shard they are
shuffled by a hash. ``mixed_documents`` delivers the texts shard by shard in that order.

Tables are handled by DataFrame functions alone. Positions come from sums per (source, bucket of
the hash) and running sums inside a bucket, so a source that holds a third of the rows is spread
over 1,024 groups. Only the quotas, one number per source and pass, are split on the driver.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.common import WHITE, staged, table, text_of, whole_row

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
BLOCKS, LEAST_WORDS = 16_384, 64
BUCKET_BITS = 10
SHARDS = 24
#: Each shard's order is cut into 2 ** SLICE_BITS slices, one task's work at most.
SLICE_BITS = 6
SEED = 11

_HEX = 15  # hexadecimal digits of a hash: 60 bits


def _hash(*parts: Column) -> Column:
    """60-bit hash that SQL can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, _HEX), 16, 10).cast("long")


def n_words(text: Column) -> Column:
    return F.regexp_count(text_of(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE,
            most: int = MOST) -> DataFrame:
    """Append ``target`` to one row per source (``source``, ``source_size``).

    Sources in code point order, null last, repeat the weights. A target stops at ``most`` times its
    source's size. Filling by weight until nothing is above means one common level: sources whose
    limit per weight lies below it get their limit, the others the level times their weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    df = sources.withColumn("w", F.element_at(
        F.array(*map(F.lit, weights)),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1)).cast("double"))
    df = df.withColumn("limit", (F.col("source_size") * most).cast("double"))
    total = Window.partitionBy()
    rising = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last())
    df = df.withColumns({
        "want": F.sum("source_size").over(total) * F.lit(share), "all_w": F.sum("w").over(total),
        "below": F.sum("limit").over(rising), "below_w": F.sum("w").over(rising),
    })
    full = F.col("below") + F.col("limit") / F.col("w") * (F.col("all_w") - F.col("below_w")) \
        <= F.col("want")
    df = df.withColumn("full", full)
    level = (F.col("want") - F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0.0)).over(total)) \
        / F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(total)
    return df.withColumn("target", F.when(F.col("full"), F.col("limit"))
                         .otherwise(F.least(F.col("w") * level, F.col("limit")))) \
        .select("source", "source_size", "target")


def split_quotas(quotas: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """Blocks per shard and pool: a tree of multivariate hypergeometric draws, exact in total."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(quotas)), np.int64)

    def node(quota: np.ndarray, first: int, last: int) -> None:
        if last - first == 1:
            out[first] = quota
            return
        middle = (first + last) // 2
        total = int(quota.sum())
        # shares differ by one block at most over all shards
        take = total * (middle - first) // (last - first)
        left = rng.multivariate_hypergeometric(quota, take, method="marginals")
        node(left, first, middle)
        node(quota - left, middle, last)

    node(np.array(quotas, np.int64), 0, shards)
    return out


def _laid_out(docs: DataFrame) -> DataFrame:
    """Append ``place``, the document's first word on its source's line, and ``row``, a row number."""
    docs = docs.withColumn("h", _hash(F.lit(f"doc{SEED}"), F.col("doc_id").cast("string"))) \
        .withColumn("bucket", F.shiftright("h", 4 * _HEX - BUCKET_BITS))
    sums = docs.groupBy("pool", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("pool").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = sums.select("pool", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0))
                       .alias("before"))
    inside = Window.partitionBy("pool", "bucket").orderBy("h", "doc_id", "size", "t")
    run = F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return docs.withColumns({"row": F.row_number().over(inside), "run": run}).join(
        sums, ["pool", "bucket"]).withColumn("place", F.col("before") + F.col("run")).drop(
        "before", "run", "h")


def _blocks(sources: DataFrame, shards: int) -> DataFrame:
    """Drawn blocks: pool, pass, block, taken words from its start, shard and order."""
    passes = sources.where("source_size > 0").select(
        "pool", "source_size", "block_words",
        F.expr("posexplode(transform(sequence(1, %d), e -> greatest(0, least(source_size, "
               "cast(round(target) as bigint) - (e - 1) * source_size))))" % MOST)
        .alias("pass", "quota")).where("quota > 0")
    last = F.floor((F.col("source_size") - 1) / F.col("block_words"))
    cut = passes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    shuffled = Window.partitionBy("pool", "pass").orderBy(
        _hash(F.lit(f"block{SEED}"), F.col("pool"), F.col("pass").cast("string"),
              F.col("block").cast("string")), "block")
    words = F.least("block_words", F.col("source_size") - F.col("block") * F.col("block_words"))
    drawn = cut.withColumn("words", words).withColumns({
        "rank": F.row_number().over(shuffled) - 1,
        "start": F.sum("words").over(shuffled.rowsBetween(Window.unboundedPreceding, 0))
        - F.col("words"),
    }).withColumn("take", F.least("words", F.col("quota") - F.col("start"))).where("take > 0")
    drawn = staged(drawn.select("pool", "pass", "block", "block_words", "rank", "take"),
                   "drawn-blocks")
    spark = sources.sparkSession
    pools = drawn.groupBy("pool", "pass").count().orderBy("pool", "pass").collect()
    dealt = split_quotas([p["count"] for p in pools], shards).cumsum(axis=0)
    quotas = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(
        [{"pool": p["pool"], "pass": p["pass"], "ends": dealt[:, i].tolist()}
         for i, p in enumerate(pools)])),
        "array<struct<pool: string, pass: int, ends: array<long>>>")))
    return drawn.join(quotas, ["pool", "pass"]).withColumns({
        "shard": F.size(F.filter("ends", lambda x: x <= F.col("rank"))),
        "order": _hash(F.lit(f"order{SEED}"), F.col("pool"), F.col("pass").cast("string"),
                       F.col("block").cast("string")),
    }).drop("ends", "rank")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        shards: int = SHARDS) -> tuple[DataFrame, DataFrame]:
    """Documents with their source's target, and the drawn pieces of documents.

    Documents: pool, bucket, row (these three name a row), doc_id, t (hash of the text), size,
    source_size, target. Pieces: the three, ``pass``, ``start`` and ``length`` in words of the
    document, ``shard`` and ``order`` (sort a shard by it, then by pool, bucket and row).

    Null texts have no words and give no piece; a null source is a source, the last one. Rows need
    no distinct ids; equal rows are drawn on their own. Other columns are not read. An empty table
    gives no rows.
    """
    name = docs[source]
    rows = staged(docs.select(
        docs[key].cast("long").alias("doc_id"), F.xxhash64(text_of(docs[text])).alias("t"),
        n_words(docs[text]).alias("size"), name.alias("source"),
        F.coalesce(F.concat(F.lit("s"), name), F.lit("n")).alias("pool")), "mix-sizes")
    sources = staged(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
                     .withColumn("pool", F.coalesce(F.concat(F.lit("s"), F.col("source")),
                                                    F.lit("n")))
                     .withColumn("block_words", F.greatest(
                         F.lit(LEAST_WORDS), F.ceil(F.col("source_size") / BLOCKS)).cast("long")),
                     "mix-sources")
    laid = staged(_laid_out(rows.drop("source")).join(sources.drop("source"), "pool"), "mix-rows")
    blocks = staged(_blocks(sources, shards), "mix-blocks")
    spans = laid.where("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("place") / F.col("block_words")),
        F.floor((F.col("place") + F.col("size") - 1) / F.col("block_words")))))
    begin = F.col("block") * F.col("block_words")
    first = F.greatest("place", begin)
    length = F.least(F.col("place") + F.col("size"), begin + F.col("take")) - first
    pieces = spans.join(blocks.drop("block_words"), ["pool", "block"]).select(
        "pool", "bucket", "row", "doc_id", "t", "size", "pass", (first - F.col("place")).alias("start"),
        length.alias("length"), "shard", "order").where("length > 0")
    return laid.drop("block_words", "place"), pieces


def op4_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, with its source's size and target."""
    docs, pieces = mix(table(spark, sf_dir, "documents"))
    row = ["pool", "bucket", "row"]
    taken = pieces.groupBy(*row).agg(F.sum("length").alias("taken"))
    return docs.join(taken, row, "left").select(
        "doc_id", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The mix as documents: per document and pass, the drawn words as one text, all columns kept.

    White space between drawn neighbours stays as it is; parts that are apart in the document are
    joined by a line feed. ``n_chars`` follows the text, if there is such a column. Rows that agree
    in id and text have one text, and each gives what the mix takes of it.

    Rows come shuffled as the tree has dealt them: a slice of a shard is in one partition, sorted by
    ``order``. A text that lies in several blocks stays whole and goes where its first block goes.
    """
    _, pieces = mix(docs, shards=shards)
    parts = pieces.groupBy("pool", "bucket", "row", "pass", "doc_id", "t").agg(
        F.sort_array(F.collect_list(F.struct("start", "length"))).alias("parts"),
        (F.sum("length") == F.first("size")).alias("whole"),
        F.min(F.struct("start", "shard", "order")).alias("first")).select(
        F.coalesce("doc_id", F.lit(-(2**63))).alias("m_doc"), F.col("t").alias("m_t"), "parts",
        "whole", F.col("first.shard").alias("m_shard"), F.struct(
            "first.order", "pool", "bucket", "row").alias("m_place"))
    keys = [F.xxhash64(text_of("text")).alias("m_t"),
            F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("m_doc")]
    once = docs.select(whole_row(docs.columns).alias("_row"), *keys).dropDuplicates(
        ["m_t", "m_doc"])
    joined = once.join(parts, ["m_t", "m_doc"])
    words = F.regexp_extract_all(F.col("_row.text"), F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))

    def part(words: Column, p: Column, i: Column) -> Column:
        body = F.array_join(F.slice(words, (p["start"] + 1).cast("int"), p["length"].cast("int")), "")
        after = F.get(F.col("parts"), i + 1)["start"]
        bare = F.rtrim(body, F.lit(WHITE))
        return F.when(after.isNull(), bare).when(after == p["start"] + p["length"], body) \
            .otherwise(F.concat(bare, F.lit("\n")))

    cut = F.transform(F.array(words), lambda w: F.array_join(
        F.transform("parts", lambda p, i: part(w, p, i)), ""))[0]
    out = joined.select("_row", F.when(F.col("whole"), F.col("_row.text")).otherwise(cut).alias("_cut"),
                        "m_shard", "m_place").repartition(
        "m_shard", F.shiftright("m_place.order", 4 * _HEX - SLICE_BITS)).sortWithinPartitions(
        "m_shard", "m_place")
    new = {"text": F.col("_cut")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("_cut").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])


def _sql_hash(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, {_HEX}) AS BIGINT)"


MIX_SQL = rf"""
d0 AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS pool,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
        lambda x: x <> '')) AS size,
    {_sql_hash(f"concat_ws('|', 'doc{SEED}', CAST(doc_id AS VARCHAR))")} AS h
  FROM documents
), s0 AS (
  SELECT source, pool, CAST(sum(size) AS BIGINT) AS source_size FROM d0 GROUP BY 1, 2
), s1 AS (
  SELECT *, CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1)
    % 3 + 1 AS INTEGER)) AS DOUBLE) AS w, CAST(source_size * {MOST} AS DOUBLE) AS lim FROM s0
), s2 AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * CAST({SHARE} AS DOUBLE) AS want,
    sum(w) OVER () AS all_w,
    sum(lim) OVER (ORDER BY lim / w, source NULLS LAST) AS below,
    sum(w) OVER (ORDER BY lim / w, source NULLS LAST) AS below_w FROM s1
), s3 AS (
  SELECT *, below + lim / w * (all_w - below_w) <= want AS is_full FROM s2
), s4 AS (
  SELECT source, pool, source_size, CASE WHEN is_full THEN lim ELSE least(lim, w * (
    (want - sum(CASE WHEN is_full THEN lim ELSE 0 END) OVER ())
    / sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())) END AS target,
    greatest({LEAST_WORDS}, CAST(ceil(source_size / {BLOCKS}.0) AS BIGINT)) AS b FROM s3
), d1 AS (
  SELECT d0.doc_id, d0.size, s4.*, row_number() OVER () AS rid,
    CAST(sum(size) OVER (PARTITION BY d0.pool ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)
    AS BIGINT) - size AS place
  FROM d0 JOIN s4 ON s4.pool = d0.pool
), p0 AS (
  SELECT pool, b, source_size, e, greatest(0, least(source_size,
    CAST(round(target) AS BIGINT) - e * source_size)) AS quota
  FROM s4, range({MOST}) t(e) WHERE source_size > 0
), p1 AS (
  SELECT *, unnest(range((source_size - 1) // b + 1)) AS blk FROM p0 WHERE quota > 0
), p2 AS (
  SELECT *, least(b, source_size - blk * b) AS words, {_sql_hash(
    f"concat_ws('|', 'block{SEED}', pool, CAST(e AS VARCHAR), CAST(blk AS VARCHAR))")} AS r
  FROM p1
), p3 AS (
  SELECT pool, e, blk, b, least(words, quota - (CAST(sum(words) OVER (PARTITION BY pool, e
    ORDER BY r, blk ROWS UNBOUNDED PRECEDING) AS BIGINT) - words)) AS take FROM p2
), t0 AS (
  SELECT rid, sum(greatest(0, least(place + size, blk * p3.b + take)
    - greatest(place, blk * p3.b))) AS taken
  FROM d1 JOIN p3 ON p3.pool = d1.pool AND p3.take > 0 AND size > 0
    AND blk BETWEEN place // d1.b AND (place + size - 1) // d1.b GROUP BY rid
)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM d1 LEFT JOIN t0 USING (rid)"""

QUERIES = {"op4_mixing_tree": op4_mixing_tree}
ORACLES = {"op4_mixing_tree": f"WITH {MIX_SQL.strip()}"}
