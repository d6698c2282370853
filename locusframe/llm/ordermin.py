"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A sketch picks, under one hash, the two least of the text's k-mers of words, each labelled with its occurrence number, and
keeps them in text order; it is equal for two texts the likelier the fewer word edits lie between them. Texts with an
equal sketch are candidates; a pair is linked if its word alignment (edit distance in a band as wide as the threshold
allows) has similarity 1 - distance / longer length of at least ``similarity``. Classes are the connected components of links.

Sketches are of five words; as edits spread evenly over a text that is just similar enough leave no five words whole,
most are of three, and of two where the longer text of a pair has fewer than ``SHORT`` words (``SKETCHES``). Texts whose
partners may be on the other side of that length have both kinds.

Equal texts (128-bit digests of their words) are one vertex. Every member of a bucket of equal sketches meets the bucket's hub first, which brings
groups of copies together. Then, in buckets that still hold several classes, all pairs of members in different classes are compared, in
tiles of bounded size. Counts of words in bins, from which an alignment's least distance follows, rule most of them out; the members that are left over
meet once more in their tiles, with their words, and are aligned there. No pair is written but the links, and of those only such as join two classes of a tile,
fewer than it has members. So every pair with an equal sketch that is near ends in one class, however crowded its buckets; ``links``
counts the links found, not those between members that other links had already brought together. A crowd of n texts that differ costs n * n / 2 comparisons of bins
(and as many alignments where neither lengths nor words tell the texts apart, only their order), but no more rows than its tiles have members.

Defined cases: null text is empty; empty texts (and those without words) form one class; texts of fewer words than a k-mer
have one, the whole; very long texts are aligned in memory linear in their words but for their commonest ones; null doc_id
comes before all others, and a class that has one has class_id null; repeated rows are in one class; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import U, mix, names_of
from .common import materialize, release, table
from .relz import word_symbols
from .repeats import Symbols, texts

#: Pairs whose longer text has fewer than SHORT words have sketches of their own.
SHORT = 12
#: (words of a k-mer, how many sketches) for pairs whose longer text has SHORT words or more, and for the others.
SKETCHES = {"long": [(5, 16), (3, 40)], "short": [(2, 40)]}
#: k-mers of a sketch.
FEW = 2
#: Bins of a text's word counts, members of a block of a crowded bucket (one for every ROOM words of a text), and pairs, or members of tiles, aligned by a task.
BINS, BLOCK, ROOM, PAIRS = 256, 1024, 512, 4096


def content_names(text: Symbols) -> tuple[int, int]:
    """A 128-bit digest of the whole sequence of words."""
    if not len(text.names):
        return 0, 0
    first, second = text.digests(np.array([0]), np.array([len(text.names)]))
    return int(first[0]), int(second[0])


def numbered_grams(grams: np.ndarray) -> np.ndarray:
    """Names of the grams with their occurrence numbers."""
    in_order = np.sort(grams)
    if not (in_order[1:] == in_order[:-1]).any():
        return mix(grams)
    by = np.argsort(grams, kind="stable")
    new = np.concatenate([[True], grams[by][1:] != grams[by][:-1]])
    nth = np.empty(len(grams), dtype=U)
    nth[by] = (np.arange(len(grams)) - np.maximum.accumulate(np.where(new, np.arange(len(grams)), 0))).astype(U)
    return mix(grams + nth * U(0x9E3779B97F4A7C15))


def kinds_of(n: int, similarity: float) -> list[tuple[int, int]]:
    """The kinds of sketches of a text of n words: those of all lengths that a similar text may have."""
    return (SKETCHES["short"] * (n < SHORT) + SKETCHES["long"] * (int(n / similarity + 1e-9) >= SHORT)) if n else []


def _seeds(k: int, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors, one for each sketch, and what tells the sketches apart."""
    return (mix(np.arange(1, many + 1, dtype=U)) << U(1)) | U(1), mix(np.arange(many, dtype=U) + U(k << 32))


#: Made once, for every kind of sketch.
SEEDS = {(k, many): _seeds(k, many) for kinds in SKETCHES.values() for k, many in kinds}


def sketches(words: np.ndarray, similarity: float = 0.8) -> np.ndarray:
    """The order-sensitive sketches of a text (int64); none of a text without words."""
    n, out = len(words), []
    for k, many in kinds_of(n, similarity):
        grams = names_of(words, min(k, n))
        labelled = numbered_grams(grams)
        rows = max(1, min(many, (1 << 19) // len(grams)))
        odd, own = SEEDS[k, many]
        for i in range(0, many, rows):
            out.append(_least_in_order(labelled[None, :] * odd[i : i + rows, None], grams, own[i : i + rows]))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _least_in_order(ranks: np.ndarray, grams: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One sketch a line: the grams at its FEW least ranks, in text order. Overwrites ranks."""
    few, lines = min(FEW, len(grams)), np.arange(len(ranks))
    places = np.empty((len(ranks), few), dtype=np.int64)
    for j in range(few):
        places[:, j] = ranks.argmin(axis=1)
        ranks[lines, places[:, j]] = U(0xFFFFFFFFFFFFFFFF)
    places.sort(axis=1)
    name = own
    for j in range(few):
        name = name * U(0xC2B2AE3D27D4EB4F) + grams[places[:, j]]
    return mix(name).view(np.int64)


def word_bins(words: np.ndarray) -> bytes:
    """How many of the words fall into each of BINS bins, 255 at most."""
    return np.minimum(np.bincount((mix(words) >> U(17)).astype(np.int64) & (BINS - 1), minlength=BINS), 255).astype(np.uint8).tobytes()


def possible_pairs(names: np.ndarray, words: np.ndarray, roots: np.ndarray, sides: np.ndarray, bins: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """The pairs of a tile (members in order of words) in different classes that word counts don't rule out; of two blocks, pairs across.

    An edit changes at most one word of each text, so the distance is at least what the counts of the bins differ by.
    """
    sums, across = bins.sum(axis=1, dtype=np.int64), bool((sides != sides[0]).any())
    ends = np.searchsorted(words, np.floor(words / similarity + 1e-9), "right")
    for i in range(len(names)):
        later = np.arange(i + 1, ends[i])
        later = later[(roots[later] != roots[i]) & ((sides[later] != sides[i]) | (not across))]
        if len(later):
            least = np.maximum(bins[later], bins[i]).sum(axis=1, dtype=np.int64) - np.minimum(sums[later], sums[i])
            for j in later[least <= np.floor((1 - similarity) * words[later] + 1e-9)]:
                yield min(names[i], names[j]), max(names[i], names[j])


def banded_distance(a: list, b: list, band: int) -> int:
    """The word edit distance of a and b if it is at most band, else some number above it.

    Bit-parallel rows of differences over a window of 2 * band + 1 rows that slides along the diagonal; outside the band
    differences are taken as +1, which no alignment of distance band or less can use. Places of a word are a list, from which
    the window's bits are set; words with many places have all their bits at hand.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > band:
        return band + 1
    start, m, n = 0, len(a), len(b)
    while start < n and a[start] == b[start]:
        start += 1
    while n > start and a[m - 1] == b[n - 1]:
        m, n = m - 1, n - 1
    a, b = a[start:m], b[start:n]
    m, n = len(a), len(b)
    if not n or not band:
        return m
    places: dict = {}
    for i, w in enumerate(a):
        places.setdefault(w, []).append(i)
    bits: dict = {}
    for w, at in places.items():
        if len(at) > 16 + m // 1024:
            flags = np.zeros(m, dtype=np.uint8)
            flags[at] = 1
            bits[w] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    width = 2 * band + 1
    mask = (1 << width) - 1
    plus, minus, base, top = mask, 0, 0, 0
    for j, w in enumerate(b, 1):
        if j - band - 1 > base:
            top += (plus & 1) - (minus & 1)
            base += 1
            plus, minus = (plus >> 1) | (mask ^ (mask >> 1)), minus >> 1
        if w in bits:
            equal = (bits[w] >> base) & mask
        else:
            equal, at = 0, places.get(w, ())
            for i in at[bisect_left(at, base) :] if at else ():
                if i >= base + width:
                    break
                equal |= 1 << (i - base)
        diagonal = (((equal & plus) + plus) ^ plus) | equal | minus
        up = minus | ~(diagonal | plus)
        down = (diagonal & plus) << 1
        up = (up << 1) | 1
        plus = (down | ~(diagonal | up)) & mask
        minus = up & diagonal & mask
        top += 1
    rows = (1 << max(0, m - base)) - 1
    if m - base > width:
        return band + 1
    return top + (plus & rows).bit_count() - (minus & rows).bit_count()


def alike(a: list, b: list, similarity: float) -> bool:
    longer = max(len(a), len(b))
    band = int((1 - similarity) * longer + 1e-9)
    return banded_distance(a, b, band) <= band


def new_links(names: np.ndarray, words: np.ndarray, roots: np.ndarray, sides: np.ndarray, lists: list[bytes], shared: list[set], bucket: int, similarity: float) -> Iterator[tuple[int, int]]:
    """Links that join the classes of a tile (members in order of words) as all its near pairs would, fewer than its members.

    ``shared`` has the crowded buckets of each member: a pair that meets in several is aligned in the least of them only.
    """
    number: dict[bytes, int] = {}
    said = [np.array([number.setdefault(w, len(number)) for w in x.split()], dtype=np.int64) for x in lists]
    bins = np.array([np.minimum(np.bincount(x & (BINS - 1), minlength=BINS), 255) for x in said], dtype=np.uint8)
    bags = [frozenset(labelled(x, len(number)).tolist()) for x in said]
    said = [x.tolist() for x in said]
    above = {r: r for r in roots.tolist()}

    def find(r: int) -> int:
        while above[r] != r:
            above[r] = r = above[above[r]]
        return r

    for i, j in possible_pairs(np.arange(len(names)), words, roots, sides, bins, similarity):
        a, b = find(int(roots[i])), find(int(roots[j]))
        if a == b or min(shared[i] & shared[j]) != bucket:
            continue
        longer = max(len(said[i]), len(said[j]))
        # Words of the longer text that the other has not cost an edit each.
        if longer - len(bags[i] & bags[j]) <= int((1 - similarity) * longer + 1e-9) and alike(said[i], said[j], similarity):
            above[a] = b
            yield min(names[i], names[j]), max(names[i], names[j])


def labelled(words: np.ndarray, many: int) -> np.ndarray:
    """The words (numbers below many) with their occurrence numbers, as one number each, in order of words."""
    words = np.sort(words)
    return words + many * (np.arange(len(words)) - np.searchsorted(words, words))


def whole_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows of whole tiles, of batches in order of tiles, and where each tile begins and ends."""

    def cut_up(rows: list[pa.RecordBatch]) -> tuple[pa.Table, list[tuple[int, int]]]:
        table = pa.Table.from_batches(rows)
        ends = [0, *(np.flatnonzero(np.diff(table["tile"].to_numpy())) + 1).tolist(), len(table)]
        return table, list(zip(ends[:-1], ends[1:], strict=True))

    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        # The last tile of a batch may go on in the next.
        names = b.column("tile").to_numpy()
        cut = int(np.searchsorted(names, names[-1]))
        if cut or (held and held[-1].column("tile")[0].as_py() != names[0]):
            yield cut_up([*held, b.slice(0, cut)])
            held = []
        held.append(b.slice(cut))
    if held:
        yield cut_up(held)


def components(links: DataFrame, what: str) -> DataFrame:
    """(a, b) -> (v, root) for all linked vertices, root the same within a component.

    Every round each vertex moves to the least of itself and its neighbours (names are random, so a constant share of
    the vertices goes) until no link is left; then the moves are composed. Nothing is collected.
    """
    moves = []
    links = materialize(links.where("a <> b").select("a", "b"), f"{what}-links")
    while links.limit(1).count():
        given = links
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        move = both.groupBy(F.col("a").alias("v")).agg(F.least(F.first("a"), F.min("b")).alias("to"))
        move = materialize(move, f"{what}-moves")
        moves.append(move)
        a, b = move.toDF("a", "x"), move.toDF("b", "y")
        # The link from a vertex to its new place stays, so that nothing comes apart.
        links = links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        links = materialize(links.where("a <> b").distinct(), f"{what}-links")
        release(given)
    if not moves:
        return links.selectExpr("a AS v", "b AS root")
    roots = moves[-1].toDF("v", "root")
    for move in reversed(moves[:-1]):
        later = roots.toDF("to", "root")
        roots = materialize(move.join(later, "to", "left").select("v", F.coalesce("root", "to").alias("root")), f"{what}-roots")
    release(*moves[:-1])
    return roots


def near_classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, text) -> one row per document: doc, version (repeats.texts), class_doc, class_version (the class's least), class_size, links."""
    staged: list[DataFrame] = []

    def kept(df: DataFrame, what: str) -> DataFrame:
        staged.append(materialize(df, f"near-{what}"))
        return staged[-1]

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.binary()]
        for b in batches:
            rows = []
            for doc, version, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = word_symbols(body)
                rows.append((doc, version, *content_names(words), len(words.names), sketches(words.names, similarity), word_bins(words.names)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=["doc", "version", "content", "check", "words", "sketch", "bins"])

    keyed = texts(docs)
    all_rows = kept(keyed.mapInArrow(sketched, "doc long, version long, content long, check long, words long, sketch array<long>, bins binary"), "sketches")
    contents = all_rows.groupBy("content", "check").agg(F.min(F.struct("doc", "version")).alias("at"), *(F.first(c).alias(c) for c in ("words", "sketch", "bins")))
    contents = kept(contents, "contents")
    # A vertex is named by 64 bits of its digest; should two share them, both are renamed by all 128.
    same = contents.groupBy("content").agg(F.count("*").alias("texts")).where("texts > 1")
    if same.limit(1).count():

        def told_apart(df: DataFrame) -> DataFrame:
            other = F.when(F.col("texts").isNotNull(), F.xxhash64("content", "check")).otherwise(F.col("content"))
            return df.join(same, "content", "left").withColumn("content", other).drop("texts")

        all_rows, contents = kept(told_apart(all_rows), "sketches"), kept(told_apart(contents), "contents")
    everywhere = contents.select("content", "words", F.explode("sketch").alias("bucket"))
    shared = everywhere.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1").select("bucket")
    # Sketches that no other text has are read once.
    members = kept(everywhere.join(shared, "bucket"), "members")

    def candidates(rows: DataFrame) -> DataFrame:
        """Members with their bucket's hub, its least name."""
        hub = F.min(F.struct(F.xxhash64("content").alias("order"), "content", "words")).alias("hub")
        of_bucket = rows.groupBy("bucket").agg(hub).select("bucket", "hub.content", "hub.words").toDF("bucket", "hub", "hub_words")
        pairs = rows.join(kept(of_bucket, "hubs"), "bucket").where("content <> hub")
        # Lengths alone can rule a pair out.
        fits = F.least("words", "hub_words") >= similarity * F.greatest("words", "hub_words") - 1e-9
        return pairs.where(fits).select(F.least("content", "hub").alias("a"), F.greatest("content", "hub").alias("b")).distinct()

    def open_members(rows: DataFrame, classes: DataFrame) -> DataFrame:
        """(content, words, bucket, root, members, major): the members of buckets that hold several classes, with the bucket's size and largest class, in members of at most ROOM words."""
        rows = rows.join(classes.withColumnRenamed("v", "content"), "content", "left")
        rows = kept(rows.withColumn("root", F.coalesce("root", "content")), "classed")
        of_class = rows.groupBy("bucket", "root").agg(F.sum(F.greatest(F.lit(1), F.ceil(F.col("words") / ROOM))).alias("n"))
        mixed = of_class.groupBy("bucket").agg(F.sum("n").alias("members"), F.max(F.struct("n", "root")).alias("major")).where("members > major.n")
        return kept(rows.join(mixed, "bucket"), "open")

    def rest(rows: DataFrame) -> DataFrame:
        """Links between members of a bucket in different classes, whatever the bucket's size; a tile has fewer than it has members.

        Members are dealt to blocks by a hash; a tile is one block of a bucket or two, so a task holds the rows of a tile at once. The largest class of a
        crowded bucket has blocks of its own, that meet those of the others only.
        """

        def left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, tiles in whole_tiles(batches):
                words, root, own = (rows[c].to_numpy() for c in ("words", "root", "own"))
                bins = np.frombuffer(b"".join(rows["bins"].to_pylist()), dtype=np.uint8).reshape(-1, BINS)
                near = np.zeros(len(words), dtype=bool)
                for i, j in tiles:
                    for pair in possible_pairs(np.arange(i, j), words[i:j], root[i:j], own[i:j], bins[i:j], similarity):
                        near[list(pair)] = True
                yield from rows.drop_columns("bins").filter(pa.array(near)).combine_chunks().to_batches()

        def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows, tiles in whole_tiles(batches):
                name, words, root, own, bucket = (rows[c].to_numpy() for c in ("content", "words", "root", "own", "bucket"))
                pairs = []
                for i, j in tiles:
                    lists, shared = rows["list"][i:j].to_pylist(), [set(x) for x in rows["shared"][i:j].to_pylist()]
                    pairs += new_links(name[i:j], words[i:j], root[i:j], own[i:j], lists, shared, bucket[i], similarity)
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

        crowded, hashed = F.col("members") > BLOCK, F.xxhash64("content", F.lit("block"))
        others = F.when(crowded, F.ceil((F.col("members") - F.col("major.n")) / BLOCK)).otherwise(1)
        blocks = F.when(crowded, F.ceil(F.col("major.n") / BLOCK)).otherwise(0)
        of_major = crowded & (F.col("root") == F.col("major.root"))
        own = F.when(of_major, others + F.pmod(hashed, blocks)).otherwise(F.pmod(hashed, others))
        met = F.sequence(F.lit(0).cast("long"), F.when(of_major, others).otherwise(others + blocks).cast("long") - 1)
        dealt = rows.join(contents.select("content", "bins"), "content").withColumns({"own": own.cast("long"), "met": met}).withColumn("other", F.explode("met"))
        tile = F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("tile")
        dealt = dealt.select(tile, "bucket", "content", "words", "root", "own", "bins").repartition("tile").sortWithinPartitions("tile", "words")
        left = kept(dealt.mapInArrow(left_over, "tile long, bucket long, content long, words long, root long, own long"), "left")
        # Members that may be near one another are left over in all buckets that they share.
        lists = words_of(left.select("content").distinct()).join(left.groupBy("content").agg(F.collect_set("bucket").alias("shared")), "content")
        # Few bytes, but much work.
        met_again = left.join(kept(lists, "left-words"), "content").repartition(1 + left.count() // PAIRS, "tile").sortWithinPartitions("tile", "words", "content")
        return kept(met_again.mapInArrow(aligned, "a long, b long").distinct(), "joined")

    def words_of(needed: DataFrame) -> DataFrame:
        """(content, words with one space between two) of the texts needed, each read from one of its documents."""
        needed = needed.join(contents.select("content", "at.doc", "at.version"), "content")

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([word_symbols(x).data for x in b.column(1).to_pylist()], pa.binary())], names=["content", "list"])

        lists = keyed.join(needed, ["doc", "version"]).select("content", "body").mapInArrow(listed, "content long, list binary")
        return lists.dropDuplicates(["content"])

    def verified(pairs: DataFrame) -> DataFrame:
        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = [alike(x.split(), y.split(), similarity) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        pairs = materialize(pairs, "near-pairs")
        lists = materialize(words_of(pairs.select(F.col("a").alias("content")).union(pairs.select("b")).distinct()), "near-words")
        # Few bytes, but much work: as many tasks as the pairs need, not as their bytes do.
        spread = pairs.repartition(1 + pairs.count() // PAIRS)
        first = spread.join(lists.toDF("a", "list_a"), "a")
        full = first.join(lists.toDF("b", "list_b"), "b").select("a", "b", "list_a", "list_b")
        found = kept(full.mapInArrow(check, "a long, b long"), "verified")
        release(pairs, lists)
        return found

    links = verified(candidates(members))
    links = links.union(rest(open_members(members, components(links, "near"))))
    classes = components(links, "near")
    degree = links.select(F.col("a").alias("content")).union(links.select("b")).groupBy("content").agg(F.count("*").alias("links"))
    rooted = contents.select("content", "at").join(classes.withColumnRenamed("v", "content"), "content", "left")
    rooted = kept(rooted.join(degree, "content", "left").withColumn("root", F.coalesce("root", "content")), "rooted")
    counts = all_rows.groupBy("content").agg(F.count("*").alias("copies"))
    of_class = rooted.join(counts, "content").groupBy("root").agg(F.min("at").alias("least"), F.sum("copies").alias("class_size"))
    of_class = kept(of_class.select("root", "least.*", "class_size").toDF("root", "class_doc", "class_version", "class_size"), "classes")
    of_content = rooted.join(of_class, "root").select("content", "class_doc", "class_version", "class_size", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
    out = materialize(all_rows.select("doc", "version", "content").join(of_content, "content").drop("content"), "near-of-documents")
    release(*staged)
    return out


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text) -> one row per document: doc_id, class_id (the class's least doc_id), class_size, links (of its text)."""

    def id_of(doc: str):
        return F.when(F.col(doc) != -(2**63), F.col(doc))

    classes = near_classes(docs, **options)
    return classes.select(id_of("doc").alias("doc_id"), id_of("class_doc").alias("class_id"), "class_size", "links")


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all columns, that are the least doc_id of their class; of repeated rows one stays."""
    kept = near_classes(docs, **options).select(F.col("class_doc").alias("doc"), F.col("class_version").alias("version")).distinct()
    kept = materialize(kept, "near-kept")
    keys = texts(docs.select("doc_id", "text", F.struct("*").alias("row")), "row").drop("body")
    return keys.join(kept, ["doc", "version"]).dropDuplicates(["doc", "version"]).select("row.*")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
