"""Removal of repeated substrings by suffix sorting.

Every 100-byte window is dealt to a shard by its least 24-byte hash, which two equal windows share. A run of windows
with one such hash is a segment, and its bytes a snippet. Snippets whose hash no other segment has are left out, unless
they hold a window twice; all others are sorted, shard by shard, with lattica.llm.induced. Hashes only deal work out.

A shard's snippets with the same bytes stand in the sorted string once, with all their places: which windows of the first
place repeat comes from the order of suffixes and the common-prefix values, the later places are marked whole, since their
bytes are equal. Most removals are of that second kind. A hash with more bytes
of snippets than HOT is split: its snippets are dealt at random to parts that are sorted by themselves, and the windows
that stay in each part are dealt anew by the least hashes of longer strings, in the end of whole windows, until no
hash has more than HOT. So a task sorts about SHARD + HOT bytes at most, whatever one passage's share of the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.llm import induced
from lattica.llm.common import Scratch, map_rows, partitions, release, table

WINDOW = 100
GRAM = 24
#: Windows of a segment at most; a longer run, as periodic text makes, is cut.
LONGEST = 128
#: Lengths of the hashed strings by which the rest of a hot hash is dealt anew; the last one is taken again if need be.
FINER = (70, WINDOW)
#: Bytes of different snippets that are sorted together.
SHARD = 1 << 20
#: Bytes of one hash's snippets above which it is split.
HOT = 1 << 20
#: Which hashes have so many is judged by one document in so many, those of certain hashes. It only decides how work is
#: dealt: a hot hash that goes unseen is sorted by one task, on disk if need be.
HOT_SHARE = 16

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def gram_hashes(b: np.ndarray, k: int = GRAM) -> np.ndarray:
    """A mixed 64-bit polynomial hash of the k bytes from each place, put together from powers of two."""
    part, size, power = b.astype(np.uint64) + np.uint64(1), 1, _BASE
    done, length = None, 0
    while True:
        if k & size:
            if done is None:
                done, length = part, size
            else:
                n = len(b) - length - size + 1
                done = done[:n] * np.uint64(power) + part[length : length + n]
                length += size
        if size * 2 > k:
            break
        n = len(part) - size
        part = part[:n] * np.uint64(power) + part[size : size + n]
        size, power = size * 2, power * power & _MASK
    done = (done ^ (done >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return done ^ (done >> np.uint64(32))


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    out, size = v, 1
    while size * 2 <= width:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    if size < width:
        n, shift = len(v) - width + 1, width - size
        out = np.minimum(out[:n], out[shift : shift + n])
    return out


def folded(data: bytes, grams: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For consecutive segments of so many windows, whether one holds a window twice, as periodic text does. Equal
    windows begin with equal grams, so a text whose grams all differ needs no more."""
    v = np.sort(grams)
    if not (v[1:] == v[:-1]).any():
        return np.zeros(len(size), bool)
    h = gram_hashes(np.frombuffer(data, np.uint8), WINDOW)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    return np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=len(size)) > 0


def segments(data: bytes, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, start, windows, folded) of each segment, the key being the least hash of its windows' strings of so many
    bytes."""
    if len(data) < WINDOW:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty.astype(bool)
    grams = gram_hashes(np.frombuffer(data, np.uint8), gram)
    least = sliding_least(grams, WINDOW - gram + 1)
    start = np.append(0, np.flatnonzero(least[1:] != least[:-1]) + 1)
    size = np.diff(np.append(start, len(least)))
    if size.max() > LONGEST:
        pieces = -(-size // LONGEST)
        inside = np.arange(pieces.sum()) - np.repeat(pieces.cumsum() - pieces, pieces)
        start, size = np.repeat(start, pieces) + inside * LONGEST, np.minimum(np.repeat(size, pieces) - inside * LONGEST, LONGEST)
    return least[start].view(np.int64), start, size, folded(data, grams, size)


_SHIFTED = bytes((b + 2) % 256 for b in range(256))


def joined_text(texts: list[bytes], disk: induced.Disk) -> np.ndarray:
    """The strings one after the other, each followed by a mark that no string holds, and the last by the least one."""
    n = sum(map(len, texts)) + len(texts) + 1
    wide = max((max(t) for t in texts), default=0) > 253
    out, at = disk.column(n, np.uint16 if wide else np.uint8), 0
    for t in texts:
        out[at : at + len(t)] = np.frombuffer(t, np.uint8).astype(np.uint16) + 2 if wide else np.frombuffer(t.translate(_SHIFTED), np.uint8)
        out[at + len(t)] = 1
        at += len(t) + 1
    return out


def sorted_groups(texts: list[bytes], disk: induced.Disk):
    """(group, string, offset) arrays of the windows that the strings hold twice or more, group by group; a window's
    group are the neighbours in the order of suffixes that share WINDOW symbols with it."""
    size = np.array([len(t) for t in texts])
    begin = (size + 1).cumsum() - size - 1
    text = joined_text(texts, disk)
    done, p_held, new_held = 0, np.zeros(0, np.int64), np.zeros(0, bool)
    for p, shared in induced.sort_suffixes(text, disk, WINDOW, WINDOW):
        p, new = np.append(p_held, p), np.append(new_held, shared < WINDOW)
        # the last group may go on in the next block
        cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
        p_held, new_held = p[cut:], new[cut:]
        p, new = p[:cut], new[:cut]
        several = ~(new & np.append(new[1:], True))
        group, p = done + np.cumsum(new)[several], p[several]
        done += int(new.sum())
        owner = np.searchsorted(begin, p, "right") - 1
        offset = p - begin[owner]
        inside = offset + WINDOW <= size[owner]
        yield group[inside], owner[inside], offset[inside]
    # the last suffix is the end mark alone, and what is held with it no window


def repeats(texts: list[bytes], rows: np.ndarray, disk_limit: int = induced.IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Which windows also start earlier, of strings that stand at places: rows (string, id, start, dk).

    Two arrays: (string, offset, windows), runs of windows that are repeated at the string's first place, and for each
    row whether its place is the string's first. A later place repeats all windows of the string. Places are ordered by
    id and start; equal ones are both first.
    """
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    lead = order[np.append(True, np.diff(rows[order, 0]) > 0)] if len(rows) else order
    where, at = rows[lead, 1], rows[lead, 2]
    k = rows[:, 0]
    first = (rows[:, 1] == where[k]) & (rows[:, 2] == at[k])
    disk, found = induced.Disk(disk_limit), []
    for group, owner, offset in sorted_groups(texts, disk):
        if not len(group):
            continue
        cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(cut, len(group)))
        doc, start = where[owner], at[owner] + offset
        least_doc = np.repeat(np.minimum.reduceat(doc, cut), size)
        least = np.repeat(np.minimum.reduceat(np.where(doc == least_doc, start, 1 << 62), cut), size)
        later = (doc > least_doc) | (start > least)
        found.append(owner[later] << 32 | offset[later])
    disk.close()
    v = np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
    head = np.flatnonzero(np.append(True, np.diff(v) != 1)) if len(v) else np.zeros(0, np.int64)
    runs = np.stack([v[head] >> 32, v[head] & 0xFFFFFFFF, np.diff(np.append(head, len(v)))], 1)
    return runs, first


def marked(texts: list[bytes], rows: np.ndarray, rest: bool) -> list[tuple]:
    """(dk, start, windows, id, data) of the runs of repeated windows, with data null, and, if the rest is wanted, of
    the runs of all other windows, with their bytes."""
    runs, first = repeats(texts, rows)
    windows = np.array([len(t) - WINDOW + 1 for t in texts])
    again = rows[~first]
    out = list(zip(again[:, 3].tolist(), again[:, 2].tolist(), windows[again[:, 0]].tolist(), [None] * len(again), [None] * len(again)))
    begin = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    places = rows[first]
    count = np.diff(begin)[places[:, 0]]
    row = np.repeat(np.arange(len(places)), count)
    run = np.arange(count.sum()) - np.repeat(count.cumsum() - count, count) + begin[places[row, 0]]
    out += zip(places[row, 3].tolist(), (places[row, 2] + runs[run, 1]).tolist(), runs[run, 2].tolist(), [None] * len(row), [None] * len(row))
    if rest:
        for k, place, start, dk in places.tolist():
            at = 0
            for a, n in [*runs[begin[k] : begin[k + 1], 1:].tolist(), (int(windows[k]), 0)]:
                if a > at:
                    out.append((dk, start + at, a - at, place, texts[k][at : a + WINDOW - 1]))
                at = a + n
    return out


def shard_repeats(shards: DataFrame, rest: bool = False) -> DataFrame:
    """marked() of snippets (key, id, dk, start, data) that are sorted by key, dk, start within their partitions. Whole
    keys are sorted together, up to SHARD bytes. Of repeated rows, whose snippets are one and the same, one counts."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("dk", pa.int64()), ("start", pa.int64()), ("windows", pa.int64()), ("id", pa.int64()), ("data", pa.binary())])
        number: dict[bytes, int] = {}
        rows: list[tuple[int, int, int, int]] = []
        size, before = 0, (None,)

        def solved():
            out = marked(list(number), np.array(rows, np.int64).reshape(-1, 4), rest)
            for a in range(0, len(out), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[a : a + 100_000]), schema)], schema=schema)

        for batch in batches:
            for key, place, dk, start, data in zip(*[c.to_pylist() for c in batch.columns]):
                if (key, dk, start) == before:
                    continue
                if key != before[0] and (size >= SHARD or len(rows) >= SHARD >> 3):
                    yield from solved()
                    number, rows, size = {}, [], 0
                k = len(number)
                if number.setdefault(data, k) == k and len(number) > k:
                    size += len(data)
                rows.append((number[data], place, start, dk))
                before = key, dk, start
        if rows:
            yield from solved()

    return shards.mapInArrow(run, "dk long, start long, windows long, id long, data binary")


def hot_keys(rows: DataFrame, scratch: Scratch, share: int = 1) -> DataFrame:
    """(key, ways): keys with more than HOT bytes of snippets, judged by the given rows, which hold one part in `share`
    of the documents. They are few, a row for HOT bytes or more, and are written as a table, so that the size of that
    table decides how it is joined."""
    size = F.sum(F.col("windows").cast("long") + WINDOW - 1) * share
    keys = rows.groupBy("key").agg(F.ceil(size / HOT).cast("long").alias("ways"))
    return scratch.put(keys.where("ways > 1"))


def dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows (key, dk, start, windows, folded, ...) whose key has several rows or a folded one, with a column hot: rows
    of hot keys all stay, and their keys are split by dk and start."""
    if not hot.isEmpty():
        split = F.xxhash64("key", F.pmod(F.xxhash64("dk", "start"), "ways"))
        rows = rows.join(hot, "key", "left").withColumn("hot", F.col("ways").isNotNull()).withColumn("key", F.when(F.col("hot"), split).otherwise(F.col("key"))).drop("ways")
    else:
        rows = rows.withColumn("hot", F.lit(False))
    group = Window.partitionBy("key")
    rows = rows.withColumn("n", F.count("*").over(group)).withColumn("folds", F.max("folded").over(group))
    return rows.where("hot or n > 1 or folds").drop("n", "folds", "folded")


def dealt_anew(rest: DataFrame, gram: int) -> DataFrame:
    """Windows (dk, start, windows, id, data) that a part has left, as snippets by the least hashes of longer strings."""

    def run(batches):
        import pyarrow as pa

        names = ["key", "id", "dk", "start", "windows", "folded", "data"]
        for batch in batches:
            out = []
            for place, dk, start, data in zip(*[batch.column(c).to_pylist() for c in ("id", "dk", "start", "data")]):
                key, begin, windows, _ = segments(data, gram)
                out += [(k, place, dk, start + a, n, False, data[a : a + n + WINDOW - 1]) for k, a, n in zip(key.tolist(), begin.tolist(), windows.tolist())]
            for a in range(0, len(out), 50_000):
                columns = list(zip(*out[a : a + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*[pa.int64()] * 5, pa.bool_(), pa.binary()])], names=names)

    return rest.mapInArrow(run, "key long, id long, dk long, start long, windows long, folded boolean, data binary")


def covered(n: int, marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) of the bytes that the marked windows cover."""
    out: list[list[int]] = []
    for start, windows in sorted(marks):
        end = min(n, start + windows + WINDOW - 1)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, data, spans) for each row: the text's bytes and the runs [begin, end) that repeated 100-byte strings cover.

    A string counts as repeated if it also starts earlier: in a row of smaller id, or earlier in the same row. A null
    text is empty, a null id comes before all others. Rows of equal id and text are each kept as the other is, since
    neither starts earlier; rows of equal id and different text compare by place in their texts. Strings never cross
    rows. An empty table gives an empty result; other columns are not read.
    """
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    least = F.lit(-(1 << 63))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(id_col).cast("long"), least), data).alias("dk"), data.alias("data"))
    ways = partitions(docs.sparkSession)

    def emit(batches):
        import pyarrow as pa

        for batch in batches:
            held, size = [], 0
            for d, x in zip(*[batch.column(c).to_pylist() for c in ("dk", "data")]):
                key, start, windows, twice = segments(x)
                held.append((key, np.full(len(key), d), start.astype(np.int32), windows.astype(np.int16), twice))
                size += len(key)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["key", "dk", "start", "windows", "folded"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held)], names=["key", "dk", "start", "windows", "folded"])

    def snippets(of):
        # one row per place, however often its row is repeated; the texts then meet them by the same key
        once = of.select("key", "dk", "start", "windows").repartition("dk").dropDuplicates(["dk", "start"])
        return own.join(once, "dk").select("key", F.coalesce("id", least).alias("id"), "dk", F.col("start").cast("long").alias("start"), _part(F.col("data"), F.col("start"), F.col("windows")).alias("data"))

    def sharded(rows):
        return rows.select("key", "id", "dk", "start", "data").repartition(ways, "key").sortWithinPartitions("key", "dk", "start")

    mark = ["dk", "start", "windows"]
    columns = "key long, dk long, start int, windows short, folded boolean"
    hot = hot_keys(own.where(F.pmod("dk", F.lit(HOT_SHARE)) == 0).mapInArrow(emit, columns), scratch, HOT_SHARE)
    picked = scratch.put(dealt(own.mapInArrow(emit, columns), hot))
    release(docs.sparkSession)
    marks = scratch.put(shard_repeats(sharded(snippets(picked.where("not hot")))).select(*mark))
    release(docs.sparkSession)
    finer = iter([*FINER, *[WINDOW] * 60])
    # a table of its own, so that few hot snippets need no shuffle of the texts
    split = None if hot.isEmpty() else snippets(scratch.put(picked.where("hot")))
    while split is not None:
        part = scratch.put(shard_repeats(sharded(split), rest=True))
        rest = scratch.put(dealt_anew(part.where("data is not null"), next(finer)))
        hot = hot_keys(rest, scratch)
        again = scratch.put(dealt(rest, hot))
        marks = marks.unionByName(part.where("data is null").select(*mark))
        marks = marks.unionByName(scratch.put(shard_repeats(sharded(again.where("not hot"))).select(*mark)))
        split = None if hot.isEmpty() else again.where("hot")
    # a list is of one document and no longer than its text
    lists = marks.distinct().groupBy("dk").agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    return own.join(lists, "dk", "left").select("id", "data", "marks")


def _part(data: Column, start: Column, windows: Column) -> Column:
    return F.substring(data, start + 1, (windows + F.lit(WINDOW - 1)).cast("int"))


def op3_digests(marked: DataFrame) -> DataFrame:
    def make():
        def one(doc, data, marks):
            spans = covered(len(data), [(m["start"], m["windows"]) for m in marks or ()])
            kept, at = [], 0
            for a, b in spans:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            return doc, len(data), sum(b - a for a, b in spans), len(spans), hashlib.sha256(b"".join(kept)).hexdigest()

        return one

    return map_rows(marked, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, kept) for each row: removed runs as byte offsets, and the remaining bytes."""

    def make():
        def one(doc, data, marks):
            spans = covered(len(data), [(m["start"], m["windows"]) for m in marks or ()])
            kept = b"".join(data[a:b] for a, b in zip([0, *[b for _, b in spans]], [*[a for a, _ in spans], len(data)]))
            return doc, [x for s in spans for x in s], kept

        return one

    return map_rows(repeated_spans(docs, scratch, id_col, text_col), make, "doc_id long, spans array<long>, kept binary")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_digests(repeated_spans(table(spark, sf_dir, "documents"), Scratch(spark, "substrings")))
