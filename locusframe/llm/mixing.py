"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

Every source is dealt by a hash of doc_id over shards of about ``shard_docs`` documents. The words of a shard, its
documents in seeded order, are cut into equal-token blocks. Seats (blocks, repeats counted) go to sources and then to
the shards of a source by highest quotients votes / (2 seats + 1), votes being a target in blocks. A shard with q
seats for m blocks takes block i floor(((i + 1) q + u) / m) - floor((i q + u) / m) times, u from the seed: q in all, each
block q / m times rounded down or up, hence at most three times.

Defined cases: null text counts 0 words; null source is a source of its own and sorts last; null doc_id and repeated
rows are documents like any other; very long texts span many blocks; a corpus or source without words has target and taken 0; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table, word_count


def source_targets(sizes: DataFrame, cap: int = 3) -> DataFrame:
    """(key, source, source_size) -> with target: weights 1, 2, 3, ... by code point, null last, capped at cap times the size.

    The excess of capped sources is reshared by weight: targets are least(cap * size, level * weight) for the one level
    that uses up all words.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", "key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", F.pmod(F.row_number().over(by_name) - 1, F.lit(3)) + 1)
        .withColumn("ratio", cap * F.col("source_size") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("level", (F.col("total") - F.col("capped")) / F.sum("weight").over(onward))
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(everything)["level"]
    return ranked.withColumn(
        "target", F.least((cap * F.col("source_size")).cast("double"), level * F.col("weight"))
    ).drop("ratio", "total", "capped", "level")


def apportion(parties: DataFrame, within: list[str], name: str, votes: str, seats: str) -> DataFrame:
    """Sainte-Lague: adds q, whole seats per party, ``seats`` in all for each group of the columns ``within``.

    Rounding the votes at the divisor seats / votes gives nearly all seats; the few that are short or over are settled by
    the highest (lowest) quotients, ties by name.
    """
    group = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    share = F.col(votes) * F.col(seats) / F.sum(votes).over(group)
    start = parties.withColumn("share", F.coalesce(F.when(F.sum(votes).over(group) > 0, share), F.lit(0.0)))
    start = start.withColumn("first", F.floor(F.col("share") + 0.5).cast("long"))
    start = start.withColumn("short", F.col(seats) - F.sum("first").over(group)).withColumn(
        "reach", F.ceil((F.abs("short") + F.count("*").over(group)) * F.col("share") / F.greatest(F.col(seats), F.lit(1))) + 1
    )
    step = F.explode(F.expr("sequence(1L, reach)"))
    marginal = start.where("short <> 0 and share > 0").select(*within, name, "short", "share", "first", step.alias("k"))
    more = F.col("short") > 0
    # The next seat of a party with s seats has quotient share / (2 s + 1), its last one share / (2 s - 1).
    quotient = F.when(more, -F.col("share") / (2 * (F.col("first") + F.col("k")) - 1)).otherwise(
        F.col("share") / (2 * (F.col("first") - F.col("k")) + 1)
    )
    order = (Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))).orderBy("quotient", name, "k")
    settled = (
        marginal.where(more | (F.col("k") <= F.col("first")))
        .withColumn("quotient", quotient)
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= F.abs("short"))
        .groupBy(*within, name)
        .agg(F.sum(F.signum("short")).cast("long").alias("change"))
    )
    return (
        start.join(settled, [*within, name], "left")
        .withColumn("q", F.col("first") + F.coalesce("change", F.lit(0)))
        .drop("share", "first", "short", "reach", "change")
    )


def _number(*parts: Column) -> Column:
    """A whole number below 2**32 from an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, block_tokens: int = 128, shard_docs: int = 1024, cap: int = 3, seed: str = "mix", whole: bool = False
) -> DataFrame:
    """(doc_id, text, source) -> doc_id, size, source_size, target, taken, source, shard, shard_blocks, shard_quota.

    whole: all columns of docs come before these; one of docs that has the name of a new one is replaced.
    """
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    sized = materialize(
        docs.select(
            "doc_id",
            "source",
            F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"),
            word_count(F.col("text")).alias("size"),
            _number(F.lit(seed), name).alias("order"),
            _number(F.lit(seed), F.lit("shard"), name).alias("deal"),
            *([F.struct("*").alias("row")] if whole else []),
        ),
        "mix-sizes",
    )
    sources = materialize(
        source_targets(
            sized.groupBy("key").agg(
                F.first("source").alias("source"), F.sum("size").alias("source_size"), F.count("*").alias("docs")
            ),
            cap,
        ).select("key", "source_size", "target", F.ceil(F.col("docs") / shard_docs).alias("shards")),
        "mix-sources",
    )
    dealt = sized.join(sources, "key").withColumn("shard", F.col("deal") % F.col("shards"))
    shards = (
        dealt.groupBy("key", "shard", "source_size", "target")
        .agg(F.sum("size").alias("shard_size"))
        .withColumn("length", F.ceil(F.col("shard_size") / F.greatest(F.round(F.col("shard_size") / block_tokens), F.lit(1))))
        .withColumn("blocks", F.when(F.col("length") > 0, F.ceil(F.col("shard_size") / F.col("length"))).otherwise(0))
        # target * (shard_size / source_size) tokens at shard_size / blocks tokens a block
        # in millionths, as whole numbers, so that sums don't depend on their order
        .withColumn("votes", F.when(F.col("blocks") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size") * 1e6)).otherwise(0).cast("long"))
    )
    shards = materialize(shards, "mix-shards")
    votes = shards.groupBy("key").agg(F.sum("votes").alias("all_votes"))
    seats = votes.withColumn("seats", F.round(F.sum("all_votes").over(Window.partitionBy(F.lit(0))) / 1e6).cast("long"))  # one row a source
    per_source = apportion(seats, [], "key", "all_votes", "seats").select("key", F.col("q").alias("source_seats"))
    quotas = apportion(shards.join(per_source, "key"), ["key"], "shard", "votes", "source_seats").select(
        "key",
        "shard",
        "length",
        "blocks",
        F.least("q", cap * F.col("blocks")).alias("quota"),
        (_number(F.lit(seed), F.col("key"), F.col("shard").cast("string")) % F.greatest("blocks", F.lit(1))).alias("offset"),
    )
    quotas = materialize(quotas, "mix-quotas")
    line = Window.partitionBy("key", "shard").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(quotas, ["key", "shard"]).withColumn("stop", F.sum("size").over(line))

    def copies_before(block: Column) -> Column:
        return F.expr("1L") * F.floor((block * F.col("quota") + F.col("offset")) / F.col("blocks"))

    def taken_before(token: Column) -> Column:
        block = F.floor(token / F.col("length"))
        here = copies_before(block + 1) - copies_before(block)
        return F.col("length") * copies_before(block) + here * (token - block * F.col("length"))

    taken = taken_before(F.col("stop")) - taken_before(F.col("stop") - F.col("size"))
    found = placed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        F.when((F.col("size") > 0) & (F.col("blocks") > 0), taken).otherwise(0).cast("long").alias("taken"),
        "source",
        "shard",
        F.col("blocks").cast("long").alias("shard_blocks"),
        F.col("quota").cast("long").alias("shard_quota"),
        *(["row"] if whole else []),
    )
    if not whole:
        return found
    new = [c for c in found.columns if c not in ("doc_id", "source", "row")]
    return found.select(*(f"row.`{c}`" for c in docs.columns if c not in new), *new)


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def _number_sql(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def _apportion_sql(name: str, parties: str, within: str, party: str, votes: str, seats: str) -> str:
    """CTEs that end in {name}: the parties with q, as in apportion()."""
    over = f"PARTITION BY {within}" if within else ""
    keys = ", ".join(filter(None, [within, party]))
    return f"""
{name}_share AS (SELECT *, CASE WHEN sum({votes}) OVER ({over}) > 0 THEN CAST({votes} * {seats} AS DOUBLE) / CAST(sum({votes}) OVER ({over}) AS DOUBLE) ELSE 0.0 END AS share FROM {parties}),
{name}_first AS (SELECT *, CAST(floor(share + 0.5) AS BIGINT) AS first FROM {name}_share),
{name}_short AS (SELECT *, CAST({seats} - sum(first) OVER ({over}) AS BIGINT) AS short, count(*) OVER ({over}) AS parties FROM {name}_first),
{name}_steps AS (
  SELECT {keys}, short, first, k, CASE WHEN short > 0 THEN -share / (2 * (first + k) - 1) ELSE share / (2 * (first - k) + 1) END AS quotient
  FROM {name}_short, unnest(range(1, CAST(ceil((abs(short) + parties) * share / greatest({seats}, 1)) AS BIGINT) + 2)) AS t(k)
  WHERE short <> 0 AND share > 0 AND (short > 0 OR k <= first)
),
{name}_ranked AS (SELECT *, row_number() OVER ({over} ORDER BY quotient, {party}, k) AS place FROM {name}_steps),
{name}_change AS (SELECT {keys}, CAST(sum(sign(short)) AS BIGINT) AS change FROM {name}_ranked WHERE place <= abs(short) GROUP BY {keys}),
{name} AS (SELECT s.*, first + coalesce(change, 0) AS q FROM {name}_short s LEFT JOIN {name}_change USING ({keys}))"""


def _taken_sql(token: str) -> str:
    def copies(block: str) -> str:
        return f"CAST(floor(CAST(({block}) * quota + offset_ AS DOUBLE) / blocks) AS BIGINT)"

    block = f"(({token}) // length_)"
    return f"(length_ * {copies(block)} + ({copies(block + ' + 1')} - {copies(block)}) * (({token}) - {block} * length_))"


OP6_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, coalesce('s' || source, 'n') AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         {_number_sql("'mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS order_, {_number_sql("'mix:shard:' || coalesce(CAST(doc_id AS VARCHAR), 'null')")} AS deal
  FROM documents
),
sums AS (SELECT key, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM sized GROUP BY key),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM sums),
ratios AS (SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS ratio FROM weighed),
levels AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / CAST(sum(weight) OVER (ORDER BY ratio, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM ratios
),
sources AS (
  SELECT key, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, key LIMIT 1) * weight) AS target,
         CAST(ceil(docs / 1024.0) AS BIGINT) AS shards
  FROM levels
),
dealt AS (SELECT doc_id, source, key, size, order_, source_size, target, deal % shards AS shard FROM sized JOIN sources USING (key)),
sizes AS (SELECT key, shard, source_size, target, CAST(sum(size) AS BIGINT) AS shard_size FROM dealt GROUP BY ALL),
lengths AS (SELECT *, CAST(ceil(CAST(shard_size AS DOUBLE) / greatest(round(CAST(shard_size AS DOUBLE) / 128), 1)) AS BIGINT) AS length_ FROM sizes),
cut AS (SELECT *, CASE WHEN length_ > 0 THEN CAST(ceil(CAST(shard_size AS DOUBLE) / length_) AS BIGINT) ELSE 0 END AS blocks FROM lengths),
shards AS (SELECT *, CASE WHEN blocks > 0 THEN CAST(round(target * blocks / source_size * 1e6) AS BIGINT) ELSE 0 END AS votes FROM cut),
votes AS (SELECT key, CAST(sum(votes) AS BIGINT) AS all_votes FROM shards GROUP BY key),
seats AS (SELECT *, CAST(round(CAST(sum(all_votes) OVER () AS DOUBLE) / 1e6) AS BIGINT) AS seats FROM votes),
{_apportion_sql("per_source", "seats", "", "key", "all_votes", "seats")},
seated AS (SELECT s.*, p.q AS source_seats FROM shards s JOIN per_source p USING (key)),
{_apportion_sql("per_shard", "seated", "key", "shard", "votes", "source_seats")},
quotas AS (
  SELECT key, shard, length_, blocks, least(q, 3 * blocks) AS quota, {_number_sql("'mix:' || key || ':' || CAST(shard AS VARCHAR)")} % greatest(blocks, 1) AS offset_ FROM per_shard
),
placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY key, shard ORDER BY order_, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM dealt JOIN quotas USING (key, shard)
)
SELECT doc_id, size, source_size, target, CASE WHEN size > 0 AND blocks > 0 THEN {_taken_sql("stop")} - {_taken_sql("stop - size")} ELSE 0 END AS taken,
       source, shard, blocks AS shard_blocks, quota AS shard_quota
FROM placed
"""
