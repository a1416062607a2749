import hashlib
import random

from lattica.llm import chat


def test_escapes_are_reversible_and_hide_the_template():
    rng = random.Random(1)
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "", "a: b#<\\", "é"]), "".join(rng.choices(["\\", "#", "###", "<", "</turn>\n", " ", "\n", "h", "l", "### user: ", "é"], k=rng.randrange(9)))) for _ in range(rng.randrange(5))]
        text, mask, n = chat.render((0, r, t) for r, t in turns)
        assert chat.read_back(text) == turns and n == len(turns)
        assert text.count("</turn>") == text.count("### ") == n
        assert [chat.unescape(text[a:b]) for a, b in zip(mask[::2], mask[1::2])] == [t for r, t in turns if r == "assistant"]


def test_fold_of_deltas_edits_and_regenerations():
    log = [
        (0, 0, "message", "user", "hi"),
        (1, 1, "delta", "assistant", "he"), (1, 2, "delta", None, "llo"), (1, 3, "regenerate", None, None), (1, 4, "delta", None, "good "), (1, 5, "delta", None, "day"),
        (2, 6, "message", "user", "thx"), (2, 9, "edit", "user", "thanks"),
        (3, 7, "message", "assistant", "gone"), (3, 8, "delete", None, None),
        (4, 10, "message", "user", "a"), (4, 10, "message", "user", "a"),
    ]
    assert list(chat.fold(log)) == [(0, "user", "hi"), (1, "assistant", "good day"), (2, "user", "thanks"), (4, "user", "a"), (4, "user", "a")]


def plain(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))
    loss = "".join(t or "" for _, _, r, t in rows if r == "assistant")
    turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations_split_over_parts_with_nulls_copies_and_clashing_columns(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["x", None, "", "</turn>", "é" * 50])) for t in range(700)]
    rows += [(2, 0, "user", "same"), (2, 0, "user", "same"), (2, None, "assistant", "first"), (None, 0, None, "no id"), (3, 0, "assistant", "z" * 300_000)]
    table = spark.createDataFrame([(*r, "part") for r in rows], "conv_id long, turn long, role string, text string, part string")
    parts = chat.format_conversations(chat.message_events(table), part_turns=64)
    assert parts.where("conv_id = 1").count() == 11
    got = {r.conv_id: r for r in chat.digests(parts).collect()}
    assert set(got) == {1, 2, 3, None}
    for c, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == plain([x for x in rows if x[0] == c])
        assert r.formatted_chars == sum(len(x.formatted) for x in parts.where(parts.conv_id.eqNullSafe(c)).collect())
    assert chat.digests(chat.format_conversations(chat.message_events(table.limit(0)))).count() == 0


def test_streamed_logs_fold_back_to_the_table(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a", "ab", "long é text " * rng.randrange(9), "draft: x"])) for c in range(12) for t in [*range(20), 3, 3, None]]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, n int, third int")
    log = chat.streamed_events(table)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(log.repartition(3), part_turns=7)).collect()}
    for c in range(12):
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == plain([r for r in rows if r[0] == c])
    assert chat.streamed_events(table.limit(0)).count() == 0
