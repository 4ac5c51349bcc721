import random

from ridgeline.llm import chat as C

LOG = "conv_id bigint, turn bigint, seq bigint, kind string, role string, text string"


def test_render_and_parse_are_inverse():
    rnd = random.Random(1)
    bits = ["\\", "</turn>", "### ", "### User: ", "\n", "a", ":", "=", "<", "é", "#", "</turn>\n", "", " "]
    for _ in range(500):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "a: =b\\", "User"]), "".join(rnd.choices(bits, k=rnd.randint(0, 8))))
                 for _ in range(rnd.randint(0, 4))]
        out = C.render(turns)
        assert [(r, t) for r, t, _, _ in C.parse(out)] == turns
        assert [C.unescape(out[a:b]) for a, b in C.loss_spans(out)] == [t for r, t in turns if r == "assistant"]


def fold_one(events):
    """One turn by replaying its events one at a time."""
    text, role, alive = "", None, False
    for seq, kind, r, t in sorted(set(events), key=lambda e: (e[0], e[1], e[2] or "user", e[3] or "")):
        if kind == "delta" and not alive:
            continue  # a deleted turn takes no more text
        role, alive = (r or "user", kind != "delete") if kind != "delta" else (role, alive)
        text = {"message": t or "", "edit": t or "", "regenerate": "", "delta": text + (t or ""), "delete": ""}[kind]
    return (role, text) if alive else None


def test_fold_equals_replay(spark):
    rnd = random.Random(4)
    rows = []
    for c in [*range(30), None]:
        for turn in [*range(rnd.randint(1, 4)), None]:
            for seq in range(rnd.randint(1, 7)):
                kind = rnd.choice(["message", "delta", "delta", "edit", "regenerate", "delete"]) if seq else "message"
                rows.append((c, turn, seq, kind, "assistant", rnd.choice([None, "x", "y ", "zz"])))
    rows += rows[:5]
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in C.fold(spark.createDataFrame(rows, LOG).repartition(4)).collect()}
    want = {}
    for key in {r[:2] for r in rows}:
        one = fold_one([r[2:] for r in rows if r[:2] == key])
        if one:
            want[key] = one
    assert got == want


def test_odd_turns(spark):
    rows = [(1, 0, "user", None, 9), (1, 1, None, "b", 9), (1, None, "system", "c", 9), (1, 1, None, "b", 9), (None, 0, "assistant", "d", 9)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, seq int")
    out = {r["conv_id"]: r["formatted"] for r in C.format_conversations(C.fold(C.from_turns(df))).collect()}
    assert out[1] == "### System: c</turn>\n### User: </turn>\n### User: b</turn>\n### User: b</turn>\n"
    assert out[None] == "### Assistant: d</turn>\n"
    assert C.read_back(C.format_conversations(C.fold(C.from_turns(df.limit(0))))).count() == 0


def test_event_log_folds_back(spark):
    rnd = random.Random(7)
    texts = [None, "", "a", "é" * 300, "\\### Assistant: </turn> ok", "xy z\n" * 500, "w" * 40000]
    rows = [(c, rnd.choice([0, 1, 2, None]), rnd.choice(["user", "assistant", None, "tool"]), rnd.choice(texts)) for c in [*range(40), None] for _ in range(4)]
    df = spark.createDataFrame(rows + rows[:6], "conv_id bigint, turn bigint, role string, text string").repartition(5)
    log = C.event_log(df).cache()
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "edit", "delta", "regenerate", "delete"}
    assert log.groupBy("conv_id", "turn").count().agg({"count": "max"}).collect()[0][0] <= 64 + 4
    assert log.exceptAll(log.distinct()).count() > 0

    def turns(events):
        return sorted(((r["conv_id"], tuple(r["turn"]), r["role"], r["text"]) for r in C.fold(events).collect()), key=repr)

    want = turns(C.from_turns(df))
    assert turns(log) == want and len(want) == len(rows) + 6
    assert turns(log.where("kind <> 'regenerate' and kind <> 'edit'")) != want
    assert C.event_log(df.limit(0)).count() == 0
    whole = {r["conv_id"]: r["formatted"] for r in C.format_conversations(C.fold(C.from_turns(df))).collect()}
    assert {r["conv_id"]: r["formatted"] for r in C.format_conversations(C.fold(log)).collect()} == whole
