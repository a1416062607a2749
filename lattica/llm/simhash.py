"""SimHash near-dedup with multi-index hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, connected_components, map_rows, row_key, rows_that_stay, table

SHINGLE_WORDS = 4
SEED = 42
#: Fingerprints with so many or fewer differing bits are linked.
RADIUS = 4
HALF = 32
#: Buckets with more members are thinned by components before their members are paired.
DENSE = 64
#: Members of buckets that are still larger aren't paired but meet in balls of half the radius.
HUGE = 1024
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_BLOCK = 1 << 20


def word_blocks(text: bytes, size: int = _BLOCK):
    """Lower-cased words of a text, a block of about `size` bytes at a time; blocks end at white space."""
    at = 0
    while at < len(text):
        end = at + size
        while end < len(text) and text[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield text[at:end].translate(_LOWER).split()
        at = end


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash over all word shingles, repeats included; 0 without words.

    Fewer words than a shingle make one shingle. A bit is set if it is set in over half of the shingles' hashes.
    Long texts are taken in blocks that share shingle - 1 words, so memory stays bounded.
    """
    import xxhash

    h, ones, total, carried = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for words in word_blocks((text or "").encode()):
        words = carried + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lengths + 1) - 1
            begins = (ends - lengths)[: len(words) - shingle + 1].tolist()
            hashes = np.array([h(joined[a:b], SEED) for a, b in zip(begins, ends[shingle - 1 :].tolist())], ">u8")
            total += len(hashes)
            for k in range(0, len(hashes), 1 << 15):
                ones += np.unpackbits(hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        carried = words[-(shingle - 1) :] if len(words) >= shingle else words
    if not total:
        return h(b" ".join(carried), SEED) if carried else 0
    return int.from_bytes(np.packbits(ones * 2 > total).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, fp) for each row; fp holds the 64 bits as a signed long, row_key is a hash of the whole text."""

    def make():
        return lambda doc, key, text: (doc, key, int(np.uint64(fingerprint(text)).astype(np.int64)))

    own = docs.selectExpr(f"cast(`{id_col}` as long) as id", f"xxhash64(coalesce(`{text_col}`, '')) as row_key", f"`{text_col}` as text")
    return map_rows(own, make, "id long, row_key long, fp long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def ball(word: Column, bits: int) -> Column:
    """The word and all words at one differing bit."""
    flips = [0, *[(1 << i) - (1 << 64 if i == 63 else 0) for i in range(bits)]]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in flips]), lambda m: word.bitwiseXOR(m))


def buckets(fps: DataFrame) -> DataFrame:
    """(key, fp, side, n): members of every bucket that has two or more, with the bucket's size.

    Two fingerprints within 4 bits differ by at most 2 bits in the high 32 or by at most 1 in the low 32. High
    segment: balls of one bit are enumerated on both sides and meet half-way (side 0). Low segment: balls of one bit
    (side 1) are probed against exact values (side 2). Keys of the low segment have bit 32 set. One shuffle serves all.
    """
    high, low = F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    mark = F.lit(1 << HALF)
    met = fps.select("fp", F.lit(0).alias("side"), F.explode(ball(high, HALF)).alias("key"))
    probes = fps.select("fp", F.lit(1).alias("side"), F.explode(ball(low, HALF)).alias("k")).select("fp", "side", F.col("k").bitwiseOR(mark).alias("key"))
    exact = fps.select("fp", F.lit(2).alias("side"), low.bitwiseOR(mark).alias("key"))
    # A bucket counts if it holds two different fingerprints; a fingerprint's own probe and exact value always meet.
    w = Window.partitionBy("key")
    rows = met.unionByName(probes).unionByName(exact)
    rows = rows.withColumn("n", F.count("*").over(w)).withColumn("lo", F.min("fp").over(w)).withColumn("hi", F.max("fp").over(w))
    return rows.where("lo < hi").select("key", "fp", "side", "n")


def dense_components(fps: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links over distances of up to 2 bits among the given fingerprints, and their components (node, component).

    Members of a ball of one bit are within 2 bits of each other, so a ball gives links to its smallest member only,
    never pairs.
    """
    keyed = fps.select("fp", F.explode(ball(F.col("fp"), 64)).alias("key"))
    least = F.min("fp").over(Window.partitionBy("key"))
    links = scratch.put(keyed.withColumn("a", least).where("a <> fp").select("a", F.col("fp").alias("b")).distinct())
    return links, connected_components(links, scratch)


def ball_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) of up to RADIUS bits, never pairs of a group, that give the components among the given fingerprints.

    Two fingerprints within 4 bits share a midpoint within 2 bits of both, so balls of 2 bits (2,081 words each) are
    enumerated. Members of such a ball are within 4 bits of each other, and each is linked to the smallest only.
    """
    masks = F.expr("concat(array(0L), flatten(transform(sequence(0, 63), i -> transform(sequence(0, i), j -> shiftleft(1L, i) | shiftleft(1L, j)))))")
    keyed = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("key"))
    least = F.min("fp").over(Window.partitionBy("key"))
    return keyed.withColumn("a", least).where("a <> fp").select("a", F.col("fp").alias("b")).distinct()


def candidates(known: DataFrame) -> DataFrame:
    """(a, b) for members of different components that share a bucket, met half-way or by probe and exact value."""
    a, b = known.alias("a"), known.alias("b")
    met = a.join(b, F.col("a.key") == F.col("b.key")).where("(a.side = 0 and a.c < b.c) or (a.side = 1 and b.side = 2 and a.c <> b.c)")
    return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def near_links(fps: DataFrame, scratch: Scratch, dense: int = DENSE, huge: int = HUGE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that give the components over distances up to RADIUS.

    Members of a bucket are paired and verified on the whole fingerprint. A crowded bucket isn't paired as it is: its
    members are first joined into components over distances of up to 2 bits, and only members of different components
    are paired. A bucket that has over `huge` members left, as of fingerprints that share one half and little else,
    isn't paired at all: its members meet in balls. So a fingerprint is compared with `huge` others of a bucket at most.

    A word has about N * 33 * 33 / 2**32 members in the high segment and N * 33 / 2**32 in the low one for N random
    fingerprints; beyond some 10**9 of them most buckets count as crowded and beyond 10**10 as huge.
    """
    met = scratch.put(buckets(fps))
    crowded = met.where(F.col("n") > dense).select("fp").distinct()
    links, components = dense_components(crowded, scratch)
    known = met.join(components.withColumnRenamed("node", "fp"), "fp", "left").withColumn("c", F.coalesce("component", "fp"))
    w = Window.partitionBy("key")
    known = known.withColumn("lo", F.min("c").over(w)).withColumn("hi", F.max("c").over(w)).withColumn("left", F.count("*").over(w)).where("lo < hi")
    known = scratch.put(known.select("key", "fp", "side", "c", (F.col("left") > huge).alias("huge")))
    pairs = candidates(known.where("not huge")).where(distance(F.col("a"), F.col("b")) <= RADIUS)
    links = links.union(pairs.distinct())
    many = scratch.put(known.where("huge").select("fp").distinct())
    return links if many.isEmpty() else links.union(ball_links(many))


def near_groups(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row_key, fp, c, component_id) for each row: component_id is the smallest id reachable over links of up to
    RADIUS bits, c the group's smallest fingerprint.

    A null text has no words and fingerprint zero, linked like any other. Rows of equal fingerprint form one class,
    and all search runs between the classes. A null id is passed over when the smallest is taken, and repeated rows
    keep a row each. An empty table gives an empty result; other columns are not read.
    """
    rows = scratch.put(fingerprints(docs, id_col, text_col))
    classes = scratch.put(rows.groupBy("fp").agg(F.min("id").alias("id")))
    nodes = connected_components(near_links(classes.select("fp"), scratch), scratch)
    tagged = scratch.put(classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("c")))
    least = tagged.groupBy("c").agg(F.min("id").alias("component_id"))
    labelled = tagged.join(least, "c").select("fp", "c", "component_id")
    return rows.join(labelled, "fp").select("id", "row_key", "fp", "c", "component_id")


def drop_near_copies(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row with the smallest id of each group, with all its columns; of rows that share that id, the one with the
    least text hash, and of rows repeated in both, one."""
    found = scratch.put(near_groups(docs, scratch, id_col, text_col).select(row_key(F.col("id"), F.col("row_key")).alias("key"), "id", "row_key", "c", "component_id"))
    # of a group, only rows with its smallest id meet here
    stay = found.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("c").agg(F.min(F.struct("row_key", "key")).alias("s"))
    stay = stay.select(F.col("s.key").alias("key")).distinct().withColumn("stays", F.lit(True))
    decisions = found.join(stay, "key", "left").select("key", F.coalesce("stays", F.lit(False)).alias("kept"))
    return rows_that_stay(docs, row_key(F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))), decisions, scratch)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), Scratch(spark, "simhash"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
