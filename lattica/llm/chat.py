"""Chat formatting from event logs: fold streamed deltas, edits and regenerations into messages, then render."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lattica.llm.common import map_rows, partitions, table

#: Turns of a conversation that are folded and rendered together; a longer one comes out in several parts.
PART_TURNS = 256
#: The template of a turn. Texts and roles are escaped, so that neither of these strings can occur inside them.
OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
_TURN = re.compile(r"### ([^:#<]*): ([^#<]*) </turn>\n")


def escape(text: str, marks: str = "\\#<") -> str:
    for c in marks:
        text = text.replace(c, _ESCAPES[c])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], text)


def fold(events):
    """Messages (turn, role, text) from events (turn, seq, kind, role, text) sorted by turn and sequence.

    message starts a new message with a whole text; delta appends to the turn's latest message, and starts one if
    there is none; edit replaces its text; regenerate empties it, for deltas to follow; delete removes it. The role is
    the one that the message began with, or the first that a later event names. Null texts and roles count as empty.
    """
    turn, open_, role, pieces = None, False, "", []

    def done():
        if open_:
            yield turn, role, "".join(pieces)

    for t, _, kind, who, text in events:
        text = text or ""
        if t != turn or kind == "message":
            yield from done()
            turn, open_, role, pieces = t, False, "", []
        if kind == "delete":
            open_, pieces = False, []
            continue
        if kind not in ("message", "delta", "edit", "regenerate"):
            raise ValueError(f"unknown kind of event: {kind}")
        if kind in ("edit", "regenerate"):
            pieces = []
        open_, role = True, role or who or ""
        if kind != "regenerate":
            pieces.append(text)
    yield from done()


def render(messages, learned: str = "assistant") -> tuple[str, list[int], int]:
    """The formatted text, the loss mask as begin and end offsets in code points, and the number of turns."""
    out, mask, at, n = [], [], 0, 0
    for _, role, text in messages:
        head, body = OPEN + escape(role, "\\#<:") + BETWEEN, escape(text)
        if role == learned:
            mask += [at + len(head), at + len(head) + len(body)]
        out.append(head + body + CLOSE)
        at += len(out[-1])
        n += 1
    return "".join(out), mask, n


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not in the template's form")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def sorted_groups(df: DataFrame, keys: list[str], order: list[str], make, schema: str) -> DataFrame:
    """Stream each group's rows, in order, through make(): (key values, iterator of the other values) -> output rows.
    Rows are dealt by key and sorted on disk if need be; a group is never held in memory as a whole."""
    spread = df.repartition(partitions(df.sparkSession), *keys).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in keys + order])
    n, arrow = len(keys), to_arrow_schema(_parse_datatype_string(schema))

    def per_partition(batches):
        import itertools

        import pyarrow as pa

        rows = (tuple(c[i].as_py() for c in b.columns) for b in batches for i in range(b.num_rows))
        held, weight = [], 0
        for key, group in itertools.groupby(rows, key=lambda r: r[:n]):
            for got in make(key, (r[n:] for r in group)):
                held.append(got)
                weight += sum(len(x) for x in got if isinstance(x, str))
                if len(held) >= 2000 or weight >= 16 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                    held, weight = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return spread.mapInArrow(per_partition, schema)


def format_conversations(events: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, part, formatted, mask, n_turns) from an event log (conv_id, turn, seq, kind, role, text).

    The log is partitioned by conversation and run of part_turns turns, and sorted by turn and sequence; a long
    conversation is thereby split over tasks, and its formatted text is its parts in order. Null conversation ids form
    one conversation; null turns come first; ties in sequence go by kind, role and text. Repeated message rows are
    messages of their own. Other columns are not read; an empty log gives an empty result.
    """
    part = F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-(1 << 62))).cast("long")
    log = events.select(F.col("conv_id").cast("long"), part.alias("part"), F.col("turn").cast("long"), F.col("seq").cast("long"), "kind", "role", "text")

    def one(key, rows):
        formatted, mask, n = render(fold(rows))
        if n:
            yield *key, formatted, mask, n

    return sorted_groups(log, ["conv_id", "part"], ["turn", "seq", "kind", "role", "text"], one, "conv_id long, part long, formatted string, mask array<long>, n_turns long")


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, read back from its formatted parts, which stream by in order."""

    def one(key, rows):
        turns, loss, n, chars, length = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        for _, text, mask in rows:
            length += len(text)
            for role, said in read_back(text):
                turns.update(f"{role}\n{said}\n".encode())
                n += 1
            for a, b in zip(mask[::2], mask[1::2]):
                said = unescape(text[a:b])
                loss.update(said.encode())
                chars += len(said)
        yield key[0], n, turns.hexdigest(), chars, loss.hexdigest(), length

    parts = formatted.select("conv_id", "part", "formatted", "mask")
    return sorted_groups(parts, ["conv_id"], ["part"], one, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def message_events(conversations: DataFrame) -> DataFrame:
    """The log of whole messages that a table (conv_id, turn, role, text) stands for."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def streamed_events(conversations: DataFrame) -> DataFrame:
    """A log as a chat service would have written it, which folds back to the table (conv_id, turn, role, text).

    By the hash of its row a message was streamed in three deltas, or written as a draft and then edited, or begun as a
    draft, regenerated, and streamed again. Messages of one conversation and turn stand in order of role and text; null
    texts and roles are empty ones.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    own = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    own = own.withColumn("n", F.row_number().over(order)).withColumn("third", F.floor(F.length("text") / 3).cast("int"))
    event = lambda kind, said: F.struct(F.lit(kind).alias("kind"), F.when(F.lit(kind) == "message", F.col("role")).alias("role"), said.alias("text"))
    draft = F.concat(F.lit("draft: "), F.substring("text", F.lit(1), F.col("third")))
    deltas = [event("delta", F.substring("text", 1 + k * F.col("third"), F.col("third") if k < 2 else F.length("text"))) for k in range(3)]
    ways = (
        [event("message", F.lit("")), *deltas],
        [event("message", draft), event("edit", F.col("text"))],
        [event("message", F.lit("")), event("delta", draft), event("regenerate", F.lit("")), *deltas],
    )
    way = F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(len(ways)))
    events = F.when(way == 0, F.array(*ways[0])).when(way == 1, F.array(*ways[1])).otherwise(F.array(*ways[2]))
    log = own.select("conv_id", "turn", "n", F.posexplode(events).alias("step", "event"))
    return log.select("conv_id", "turn", (F.col("n") * 8 + F.col("step")).alias("seq"), "event.kind", "event.role", "event.text")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = r"\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return digests(format_conversations(streamed_events(rows)))


OP9_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\h'), '<', '\l') AS safe,
             replace(replace(replace(replace(role, '\', '\\'), '#', '\h'), '<', '\l'), ':', '\c') AS who FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(15 + length(who) + length(safe))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
