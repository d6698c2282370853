"""Annotation frames from the relational test tables, and the registered queries over them with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.matching import Matcher
from ..functions.text import natural_key, normalize, percent_decode, trim_unicode, varint_length
from ..operators import intervals as iv
from ..operators import query as q
from ..operators import spans as s
from ..operators import statistics as st
from ..operators.sort import sort_bed, sort_gff, tie_ranks
from ..sources.records import parse_bed, parse_gff
from ..staging import materialize, numbered

TAGS = ["Name", "Alias"]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gff_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its part as annotation rows; a line's place is its own columns, not a number."""
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    lines = _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_returnflag")
    joined = lines.join(part, lines["l_partkey"] == part["p_partkey"])

    def one(tag: str, *values):
        return F.struct(F.lit(tag).alias("tag"), F.array(*values).alias("values"))

    key = F.concat_ws(":", "l_orderkey", "l_linenumber")
    return joined.select(
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("src_pos"),
        F.concat(F.lit("chr"), F.col("l_suppkey")).alias("reference_sequence_name"),
        F.col("l_returnflag").alias("ty"),
        (F.col("l_orderkey") + 1).alias("start"),
        (F.col("l_orderkey") + F.col("l_quantity").cast("long")).alias("end"),
        F.array(one("Name", F.col("p_name")), one("Alias", F.col("p_brand"), F.col("p_type")), one("ID", key)).alias("attributes"),
        F.col("l_suppkey").cast("int").alias("reference_id"),
        F.col("l_extendedprice").alias("price"),
    )


def bed_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("p_partkey") * 10
    return _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("src_pos"), F.col("p_brand").alias("reference"), start.alias("start"), (start + F.col("p_size")).alias("end"), F.col("p_name").alias("name")
    )


def event_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.col("event_id") + 1 + F.floor(F.col("value") / 100)
    return _read(spark, sf_dir, "events").select(F.col("event_type").alias("reference"), F.col("event_id").alias("start"), end.alias("end"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gff_like(spark, sf_dir)
    terms = F.filter(s.configured_values(F.col("attributes"), TAGS), lambda v: v != "")
    return rows.select("src_pos", "reference_id", (F.col("start") - 1).alias("start"), (F.col("end") - F.col("start") + 1).alias("length"), terms.alias("terms"))


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    seen = materialize(observations(spark, sf_dir), "table-observations")
    spans = materialize(s.spans_of(seen, 1024), "table-spans")
    return seen, spans, materialize(s.postings_of(seen, spans), "table-postings")


def _match(mode: str, term: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = gff_like(spark, sf_dir)
        found = q.scan_matches(rows, Matcher.compile(spark, term, mode), TAGS)
        return found.select(
            F.col("src_pos.l_orderkey").alias("order_key"), F.col("src_pos.l_linenumber").alias("line_number"), "reference_sequence_name", "ty", "start", "end", "price"
        )

    return query


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(reference_id, name) of gff_like."""
    return _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("int").alias("reference_id"), F.concat(F.lit("chr"), "s_suppkey").alias("name"))


def indexed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two steps: terms to spans, contigs, spans to records, values verified."""
    _, spans, postings = _index(spark, sf_dir)
    matcher = Matcher.compile(spark, "promo", "exact")
    wanted = q.requested_spans(postings, spans, references(spark, sf_dir), matcher, ["chr1", "CHR2", "Chr3"])
    keyed = gff_like(spark, sf_dir).withColumn("span_start", F.col("start") - 1).withColumn("length", F.col("end") - F.col("start") + 1)
    rows = keyed.join(wanted.select("reference_id", F.col("start").alias("span_start"), "length"), ["reference_id", "span_start", "length"], "left_semi")
    return q.verified(rows, matcher, TAGS).select(F.col("src_pos.l_orderkey").alias("order_key"), F.col("src_pos.l_linenumber").alias("line_number"), "reference_id", "start", "end", "price")


def contig_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = q.on_contigs(references(spark, sf_dir), ["Chr1", "chr3", "chr"])
    rows = gff_like(spark, sf_dir).join(wanted.select("reference_id"), "reference_id", "left_semi")
    return rows.select(F.col("src_pos.l_orderkey").alias("order_key"), F.col("src_pos.l_linenumber").alias("line_number"), "reference_sequence_name", "price")


def build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.build_counts(*_index(spark, sf_dir))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.spans_of(materialize(observations(spark, sf_dir), "table-observations"), 1024)


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _index(spark, sf_dir)[2]


def posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = s.posting_lists(_index(spark, sf_dir)[2])
    return lists.select("term", F.size("span_ids").cast("long").alias("ids"), F.sha2(F.array_join(F.transform("span_ids", lambda x: x.cast("string")), ","), 256).alias("ids_sha256"))


def posting_varint_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.posting_bytes(_index(spark, sf_dir)[2])


def start_delta_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.start_bytes(_index(spark, sf_dir)[1])


def length_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.length_bytes(_index(spark, sf_dir)[1])


def duplicate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).groupBy(*s.SPAN).agg(F.count("*").alias("records")).where("records > 1")


def natural_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.natural_order(_read(spark, sf_dir, "part"), "p_brand")


def sorted_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record's place in its contig after sorting."""
    by = Window.partitionBy("reference").orderBy("start", "end", "src_pos")
    rows = bed_like(spark, sf_dir).withColumn("natural", natural_key(F.col("reference")))
    return rows.select("reference", "natural", "src_pos", F.row_number().over(by).cast("long").alias("place"))


def overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = event_ranges(spark, sf_dir)
    return iv.overlap_join(a, a, 4).where("a_start < b_start").select("a_reference", "a_start", "a_end", "b_start", "b_end")


def coalesced_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iv.coalesce_ranges(event_ranges(spark, sf_dir), 1024)


def sortedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select(F.col("event_id").alias("src_pos"), F.col("event_type").alias("reference"), F.floor(F.col("value")).alias("start"))
    return iv.out_of_order(rows)


def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records whose span is that of a PROMO part's record."""
    rows = observations(spark, sf_dir)
    wanted = rows.where(F.array_contains("terms", "promo")).select(*s.SPAN)
    found = rows.join(wanted, s.SPAN, "left_semi")
    return found.select(F.col("src_pos.l_orderkey").alias("order_key"), F.col("src_pos.l_linenumber").alias("line_number"), *s.SPAN)


def resolved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span ids to spans, repeats kept."""
    _, found, _ = _index(spark, sf_dir)
    twice = found.select(F.explode(F.array(F.col("span_id"), F.lit(0).cast("long"))).alias("span_id"), F.col("span_id").alias("asked"))
    given = twice.select((F.col("asked") * 2 + (F.col("span_id") == 0).cast("long")).alias("pos"), "span_id").distinct()
    return s.resolve_spans(given, found).select("pos", "span_id", *s.SPAN)


def normalized_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("\t  "), F.col("p_name"), F.lit("É  "))
    return _read(spark, sf_dir, "part").select("p_partkey", normalize(raw).alias("term"), trim_unicode(raw).alias("trimmed"), percent_decode(F.concat(F.replace("p_name", F.lit(" "), F.lit("%20")), F.lit("+%zz%C3%a9%"))).alias("decoded"))


def varints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", varint_length(F.col("o_orderkey") * F.col("o_custkey")).alias("bytes"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", F.sha2(F.col("p_name"), 256).alias("sha256"))


def attribute_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every configured value of every record, in order."""
    from ..sources.records import attribute_values as values

    rows = gff_like(spark, sf_dir).select("src_pos", F.posexplode(F.concat(values(F.col("attributes"), "Name"), values(F.col("attributes"), "Alias"))).alias("place", "value"))
    return rows.select(F.col("src_pos.l_orderkey").alias("order_key"), F.col("src_pos.l_linenumber").alias("line_number"), F.col("src_pos.l_extendedprice").alias("price"), "place", "value")


def byte_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("src_pos"), F.col("p_name").alias("value"))
    return iv.byte_offsets(lines, 64)


def tie_order_topological(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records at one place a customer, each the child of the order before it: parents first, then source order."""
    by = Window.partitionBy("o_custkey").orderBy(F.col("o_orderkey").desc())
    rows = _read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("src_pos"), F.col("o_custkey").cast("string").alias("contig"), F.col("o_custkey").cast("string").alias("contig_key"),
        F.lit(1).cast("long").alias("start"), F.lit(2).cast("long").alias("end"), F.array(F.col("o_orderkey").cast("string")).alias("ids"),
        F.filter(F.array(F.lag(F.col("o_orderkey").cast("string")).over(by)), lambda x: x.isNotNull()).alias("parents"),
    )
    return tie_ranks(rows).select("contig", "src_pos", "tie")


def gff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as GFF3 lines (src_pos, value, fasta): contigs of three shapes, spans shared within a customer, an order's Parent is the next one of its customer."""
    later = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    contig = F.when(cust % 3 == 0, F.concat(F.lit("chr"), cust)).when(cust % 3 == 1, F.concat(F.lit("Chr"), cust % 50)).otherwise(F.concat(F.lit("mt_0"), cust % 7))
    attributes = F.concat_ws(";", F.concat(F.lit("ID=o%2D"), key), F.concat(F.lit("Parent=o-"), later), F.concat(F.lit("Note=a%20b,"), "o_orderpriority"), F.lit("x%3Dy=%zz"))
    value = F.concat_ws("\t", contig, F.lit("tab"), F.col("o_orderstatus"), cust + 1, F.concat(F.lit("+"), cust + 9), F.lit("."), F.when(key % 2 == 0, "+").otherwise("-"), F.lit("."), attributes)
    lines = _read(spark, sf_dir, "orders").select(key.alias("src_pos"), value.alias("value"))
    return lines.withColumn("fasta", F.lit(None).cast("long"))


def bed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as BED lines (src_pos, value); contig numbers have up to 24 digits, some lead with 0."""
    key = F.col("p_partkey")
    contig = F.concat(F.when(key % 2 == 0, "Arm").otherwise("arm"), F.when(key % 5 == 0, F.concat(F.lit("0"), key % 40)).when(key % 5 == 1, F.concat(F.lit("123456789012345678901"), key % 400)).otherwise((key % 30 + 1).cast("string")))
    return _read(spark, sf_dir, "part").select(key.alias("src_pos"), F.concat_ws("\t", contig, key % 97, key % 97 + F.col("p_size"), F.col("p_name")).alias("value"))


def parsed_gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GFF3 lines to records: coordinates, strand, decoded attribute values in order."""
    from ..sources.records import attribute_values as values

    rows = parse_gff(gff_text(spark, sf_dir).drop("fasta"))
    decoded = F.array_join(F.concat(*(values(F.col("attributes"), t) for t in ("ID", "Parent", "Note", "x=y"))), "|")
    return rows.select("src_pos", "line_no", "reference_sequence_name", "source", "ty", "start", "end", "score", "strand", "phase", F.size("attributes").cast("long").alias("tags"), decoded.alias("decoded"))


def parsed_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse_bed(bed_text(spark, sf_dir).withColumn("value", F.concat("value", F.lit("\textra"))))
    return rows.select("src_pos", "line_no", "reference_sequence_name", "ty", "start", "end", F.col("attributes")[0]["values"][0].alias("name"))


def sorted_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each BED line's place in the sorted file."""
    placed = sort_bed(bed_text(spark, sf_dir)).withColumn("at", F.monotonically_increasing_id())
    return numbered(placed, ["at"], "place", "table-sorted").drop("at")


def sorted_gff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each GFF3 line's place in the sorted file: natural contigs, coordinates, parents before children."""
    placed = sort_gff(gff_text(spark, sf_dir)).withColumn("at", F.monotonically_increasing_id())
    return numbered(placed, ["at"], "place", "table-sorted").select("place", F.substring_index("raw_line", "\t", 5).alias("feature"), F.regexp_extract("raw_line", "ID=o%2D([0-9]+)", 1).cast("long").alias("order_key"))


def returned_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a repeated tag the last occurrence counts, at the place of the first."""
    from ..sources.records import last_of_each_tag

    lines = gff_text(spark, sf_dir).select("src_pos", F.concat("value", F.lit(";ID=last")).alias("value"))
    rows = parse_gff(lines).select("src_pos", F.posexplode(last_of_each_tag(F.col("attributes"))).alias("place", "a"))
    return rows.select("src_pos", "place", F.col("a.tag").alias("tag"), F.array_join("a.values", ",").alias("joined"))


QUERIES = {
    "match_exact": _match("exact", "PROMO"),
    "match_prefix": _match("prefix", "cold"),
    "match_contains": _match("contains", " widg"),
    "match_regex": _match("regex", r"^brand#\d[35]$|WIDGET$"),
    "indexed_query": indexed_query,
    "contig_filter": contig_filter,
    "build_stats": build_stats,
    "spans": spans,
    "postings": postings,
    "posting_lists": posting_lists,
    "posting_varint_bytes": posting_varint_bytes,
    "start_delta_bytes": start_delta_bytes,
    "length_bytes": length_bytes,
    "duplicate_spans": duplicate_spans,
    "natural_rank": natural_rank,
    "sorted_order": sorted_order,
    "overlap_join": overlap_join,
    "coalesced_intervals": coalesced_intervals,
    "sortedness": sortedness,
    "requested_span_semi_join": semi_join,
    "resolved_spans": resolved_spans,
    "normalized_terms": normalized_terms,
    "varint_length": varints,
    "fingerprint": fingerprints,
    "attribute_values": attribute_values,
    "byte_offsets": byte_offsets,
    "tie_order_topological": tie_order_topological,
    "parsed_gff": parsed_gff,
    "parsed_bed": parsed_bed,
    "sorted_bed": sorted_bed,
    "sorted_gff": sorted_gff,
    "returned_attributes": returned_attributes,
}

_ROWS = """
rows AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, 'chr' || l_suppkey AS reference_sequence_name, l_returnflag AS ty,
         l_orderkey + 1 AS start, l_orderkey + CAST(l_quantity AS BIGINT) AS "end", CAST(l_suppkey AS INTEGER) AS reference_id,
         l_orderkey AS span_start, CAST(l_quantity AS BIGINT) AS length, [lower(p_name), lower(p_brand), lower(p_type)] AS terms, p_name, p_brand, p_type
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""
_SPANS = """
distinct_spans AS (SELECT DISTINCT reference_id, span_start, length FROM rows),
spans AS (
  SELECT row_number() OVER (ORDER BY reference_id, span_start, length) - 1 AS span_id, reference_id, span_start, length,
         (row_number() OVER (PARTITION BY reference_id ORDER BY span_start, length) - 1) // 1024 AS own_block
  FROM distinct_spans
),
blocks AS (SELECT reference_id, own_block, row_number() OVER (ORDER BY reference_id, own_block) - 1 AS block_id FROM (SELECT DISTINCT reference_id, own_block FROM spans)),
numbered AS (SELECT span_id, reference_id, span_start AS start, length, block_id FROM spans JOIN blocks USING (reference_id, own_block)),
postings AS (
  SELECT DISTINCT term, span_id FROM (SELECT unnest(terms) AS term, reference_id, span_start, length FROM rows) JOIN spans USING (reference_id, span_start, length)
)"""
_VLEN = "CAST(ceil(length(bin({0})) / 7.0) AS BIGINT)"


def _match_sql(test: str) -> str:
    return f"""WITH {_ROWS} SELECT l_orderkey AS order_key, l_linenumber AS line_number, reference_sequence_name, ty, start, "end", l_extendedprice AS price
FROM rows WHERE len(list_filter(terms, lambda t: {test})) > 0"""


_GFF = """
made AS (
  SELECT *, CASE o_custkey % 3 WHEN 0 THEN 'chr' || o_custkey WHEN 1 THEN 'Chr' || (o_custkey % 50) ELSE 'mt_0' || (o_custkey % 7) END AS contig,
         CASE o_custkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 0 ELSE 1 END AS shape, CASE o_custkey % 3 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey % 50 ELSE o_custkey % 7 END AS number,
         lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS later
  FROM orders
)"""
_BED = """
made AS (
  SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'Arm' ELSE 'arm' END || CASE p_partkey % 5 WHEN 0 THEN '0' || (p_partkey % 40) WHEN 1 THEN '123456789012345678901' || (p_partkey % 400) ELSE CAST(p_partkey % 30 + 1 AS VARCHAR) END AS contig,
         p_partkey % 97 AS low, p_partkey % 97 + p_size AS high
  FROM part
)"""
_EVENTS = "ranges AS (SELECT event_type AS reference, event_id AS start, event_id + 1 + CAST(floor(value / 100) AS BIGINT) AS \"end\" FROM events)"
_INDEX = f"WITH {_ROWS}, {_SPANS}"
ORACLES = {
    "match_exact": _match_sql("t = 'promo'"),
    "match_prefix": _match_sql("starts_with(t, 'cold')"),
    "match_contains": _match_sql("contains(t, 'widg')"),
    "match_regex": _match_sql("regexp_matches(t, '^brand#[0-9][35]$|widget$')"),
    "indexed_query": f"""{_INDEX}, wanted AS (SELECT DISTINCT reference_id, span_start, length FROM rows WHERE list_contains(terms, 'promo') AND reference_id IN (1, 2, 3))
SELECT l_orderkey AS order_key, l_linenumber AS line_number, reference_id, start, "end", l_extendedprice AS price
FROM rows SEMI JOIN wanted USING (reference_id, span_start, length) WHERE list_contains(terms, 'promo')""",
    "contig_filter": f"WITH {_ROWS} SELECT l_orderkey AS order_key, l_linenumber AS line_number, reference_sequence_name, l_extendedprice AS price FROM rows WHERE lower(reference_sequence_name) IN ('chr1', 'chr3')",
    "build_stats": f"""{_INDEX} SELECT r.n AS records_processed, r.n AS records_indexed, p.terms AS distinct_terms, s.n AS unique_spans, p.n AS postings,
3 * r.n - p.n AS duplicate_postings_removed, r.n - s.n AS duplicate_spans_removed
FROM (SELECT count(*) AS n FROM rows) r, (SELECT count(*) AS n FROM spans) s, (SELECT count(*) AS n, count(DISTINCT term) AS terms FROM postings) p""",
    "spans": f"{_INDEX} SELECT span_id, reference_id, start, length, block_id FROM numbered",
    "postings": f"{_INDEX} SELECT term, span_id FROM postings",
    "posting_lists": f"{_INDEX} SELECT term, count(*) AS ids, sha256(string_agg(CAST(span_id AS VARCHAR), ',' ORDER BY span_id)) AS ids_sha256 FROM postings GROUP BY term",
    "posting_varint_bytes": f"""{_INDEX}, gaps AS (SELECT term, span_id - coalesce(lag(span_id) OVER (PARTITION BY term ORDER BY span_id), 0) AS gap FROM postings)
SELECT term, count(*) AS ids, CAST(sum({_VLEN.format('gap')}) + {_VLEN.format('count(*)')} AS BIGINT) AS posting_bytes FROM gaps GROUP BY term""",
    "start_delta_bytes": f"""{_INDEX}, gaps AS (SELECT block_id, span_id, start - lag(start) OVER (PARTITION BY block_id ORDER BY start, length) AS gap FROM numbered)
SELECT block_id, count(*) AS block_rows, min(span_id) AS first_span_id, CAST(sum(CASE WHEN gap IS NULL THEN 0 ELSE {_VLEN.format('gap')} END) AS BIGINT) AS start_bytes FROM gaps GROUP BY block_id""",
    "length_bytes": f"""{_INDEX}, sums AS (
  SELECT block_id, CAST(sum({_VLEN.format('length')}) AS BIGINT) AS varints, CASE WHEN max(length) = min(length) THEN 0 ELSE length(bin(max(length) - min(length))) END AS width, count(*) AS n
  FROM numbered GROUP BY block_id
), packed AS (SELECT *, CAST(ceil(n * width / 8.0) AS BIGINT) AS bytes FROM sums)
SELECT block_id, width <= 63 AND bytes < varints AS is_packed, 20 + CASE WHEN width <= 63 AND bytes < varints THEN bytes ELSE varints END AS length_bytes FROM packed""",
    "duplicate_spans": f"WITH {_ROWS} SELECT reference_id, span_start AS start, length, count(*) AS records FROM rows GROUP BY ALL HAVING count(*) > 1",
    "natural_rank": "SELECT p_brand, dense_rank() OVER (ORDER BY CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT)) AS natural_rank FROM (SELECT DISTINCT p_brand FROM part)",
    "sorted_order": """SELECT p_brand AS reference, 'brand#1' || lpad(CAST(length(p_brand) - 6 AS VARCHAR), 10, '0') || substr(p_brand, 7) AS "natural",
p_partkey AS src_pos, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey * 10, p_partkey * 10 + p_size, p_partkey) AS place FROM part""",
    "overlap_join": f"""WITH {_EVENTS} SELECT a.reference AS a_reference, a.start AS a_start, a."end" AS a_end, b.start AS b_start, b."end" AS b_end
FROM ranges a JOIN ranges b ON a.reference = b.reference AND a.start < b."end" AND b.start < a."end" AND a.start < b.start""",
    "coalesced_intervals": f"""WITH {_EVENTS}, marked AS (
  SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY reference ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ranges
), islands AS (SELECT *, sum(fresh) OVER (PARTITION BY reference ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM marked)
SELECT reference, min(start) AS start, max("end") AS "end", count(*) AS merged FROM islands GROUP BY reference, island""",
    "sortedness": """WITH r AS (SELECT event_id AS src_pos, event_type AS reference, CAST(floor(value) AS BIGINT) AS start FROM events), l AS (
  SELECT *, lag(start) OVER w AS before, lag(src_pos) OVER w AS place_before FROM r WINDOW w AS (PARTITION BY reference ORDER BY src_pos)
) SELECT src_pos, reference, start FROM l WHERE start < before OR src_pos <> place_before + 1""",
    "requested_span_semi_join": f"""WITH {_ROWS} SELECT l_orderkey AS order_key, l_linenumber AS line_number, reference_id, span_start AS start, length
FROM rows r WHERE EXISTS (SELECT 1 FROM rows w WHERE w.reference_id = r.reference_id AND w.span_start = r.span_start AND w.length = r.length AND list_contains(w.terms, 'promo'))""",
    "resolved_spans": f"{_INDEX} SELECT i AS pos, span_id, reference_id, start, length FROM (SELECT DISTINCT 2 * span_id + CASE WHEN asked = 0 THEN 1 ELSE 0 END AS i, asked AS span_id FROM (SELECT span_id, unnest([span_id, 0]) AS asked FROM numbered)) JOIN numbered USING (span_id)",
    "normalized_terms": "SELECT p_partkey, translate(p_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || chr(201) AS term, p_name || chr(201) AS trimmed, p_name || '+%zz' || chr(233) || '%' AS decoded FROM part",
    "byte_offsets": "SELECT p_partkey AS src_pos, p_name AS value, CAST(coalesce(sum(strlen(p_name) + 1) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM part",
    # An order's parent is the next of its customer, so parents first is by falling key.
    "tie_order_topological": """SELECT CAST(o_custkey AS VARCHAR) AS contig, o_orderkey AS src_pos,
CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) - 1 ELSE o_orderkey END AS tie FROM orders""",
    "parsed_gff": f"""WITH {_GFF} SELECT o_orderkey AS src_pos, o_orderkey + 1 AS line_no, contig AS reference_sequence_name, 'tab' AS source, o_orderstatus AS ty, o_custkey + 1 AS start, o_custkey + 9 AS "end",
'.' AS score, CASE WHEN o_orderkey % 2 = 0 THEN '+' ELSE '-' END AS strand, '.' AS phase, CASE WHEN later IS NULL THEN 3 ELSE 4 END AS tags,
'o-' || o_orderkey || coalesce('|o-' || later, '') || '|a b|' || o_orderpriority || '|%zz' AS decoded FROM made""",
    "parsed_bed": f"""WITH {_BED} SELECT p_partkey AS src_pos, p_partkey + 1 AS line_no, contig AS reference_sequence_name, 'bed' AS ty, low + 1 AS start, high AS "end", p_name AS name FROM made""",
    "sorted_bed": f"""WITH {_BED}, parts AS (SELECT *, substr(contig, 4) AS digits FROM made)
SELECT contig || chr(9) || low || chr(9) || high || chr(9) || p_name AS raw_line,
row_number() OVER (ORDER BY CASE WHEN digits LIKE '0%' THEN 0 ELSE 1 END, CASE WHEN digits LIKE '0%' THEN digits END, CASE WHEN digits LIKE '0%' THEN NULL ELSE CAST(digits AS HUGEINT) END, low, high, p_partkey) - 1 AS place FROM parts""",
    # Customers of one contig and number may share neither span nor parents: within a customer parents come first, by falling key.
    "sorted_gff": f"""WITH {_GFF} SELECT row_number() OVER (ORDER BY shape, number, o_custkey, o_orderkey DESC) - 1 AS place,
contig || chr(9) || 'tab' || chr(9) || o_orderstatus || chr(9) || (o_custkey + 1) || chr(9) || '+' || (o_custkey + 9) AS feature, o_orderkey AS order_key FROM made""",
    "returned_attributes": f"""WITH {_GFF}, tags AS (
  SELECT o_orderkey AS src_pos, unnest(list_filter([{{'tag': 'ID', 'joined': 'last'}}, CASE WHEN later IS NOT NULL THEN {{'tag': 'Parent', 'joined': 'o-' || later}} END, {{'tag': 'Note', 'joined': 'a b,' || o_orderpriority}}, {{'tag': 'x=y', 'joined': '%zz'}}], lambda t: t IS NOT NULL)) AS a FROM made
) SELECT src_pos, CAST(row_number() OVER (PARTITION BY src_pos ORDER BY list_position(['ID', 'Parent', 'Note', 'x=y'], a.tag)) - 1 AS INTEGER) AS place, a.tag AS tag, a.joined AS joined FROM tags""",
    "varint_length": f"SELECT o_orderkey, {_VLEN.format('o_orderkey * o_custkey')} AS bytes FROM orders",
    "fingerprint": "SELECT p_partkey, sha256(p_name) AS sha256 FROM part",
    "attribute_values": f"""WITH {_ROWS} SELECT l_orderkey AS order_key, l_linenumber AS line_number, l_extendedprice AS price, CAST(i AS INTEGER) AS place, [p_name, p_brand, p_type][i + 1] AS value
FROM rows, range(0, 3) t(i)""",
}
