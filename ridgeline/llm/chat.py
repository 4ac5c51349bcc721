"""Chat formatting: conversations rebuilt from an event log, then rendered.

Log rows: ``conv_id, turn, seq, kind, role, text``.  Kinds, applied per turn in
``seq`` order: ``message`` and ``edit`` set the text, ``regenerate`` empties it
(a new answer is streamed next), ``delta`` appends, ``delete`` removes the turn until a
``message``, ``edit`` or ``regenerate``.
Ties in ``seq`` are applied in the order of kind, role and text, so the result
never depends on the partitioning.

Spark does the folding: everything before a turn's last reset (any kind but
``delta``) is dropped after one max-aggregate, what is left is one piece of final
text each, and turns are assembled from sorted pieces.  What reaches one group is
only text that stands in the final conversation, i.e. in one output row.

Template: a turn is ``### Role: text</turn>\\n``.  Inside texts a backslash is put
in front of every backslash, of ``</turn>`` and of ``### `` (any role), so control
strings appear unescaped only where the template wrote them, and one pass over the
output reads the turns back.  Roles: system, user, assistant; any other role is
written as ``### =<escaped role>: `` with ``:`` and ``=`` escaped too.

Defined results: null text counts as empty, null role as ``user``, null turn sorts
first, null ``conv_id`` is a conversation like another.  Equal rows of a log are one
event delivered twice and count once; repeated rows of a plain table (``from_turns``)
are separate turns.  An empty log gives no rows.  Other columns
are ignored.
Very long texts are values like others: they are read whole.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import local_table, table

ROLES = {"system": "System", "user": "User", "assistant": "Assistant"}
_NAMES = {v: k for k, v in ROLES.items()}
END = "</turn>"
_ESCAPE = re.compile(r"\\|</turn>|### ")
_ESCAPE_ROLE = re.compile(r"\\|</turn>|### |:|=")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_HEAD = re.compile(r"### (System|User|Assistant|=((?:[^\\:]|\\.)*)): ", re.S)
_BODY = re.compile(r"((?:[^\\<]|\\.|<(?!/turn>))*)</turn>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> str:
    """The formatted conversation of ``(role, text)`` pairs."""
    out = []
    for role, text in turns:
        head = ROLES.get(role) or "=" + _ESCAPE_ROLE.sub(lambda m: "\\" + m[0], role)
        out.append(f"### {head}: {escape(text)}{END}\n")
    return "".join(out)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """Turns ``(role, text, start, end)`` of a formatted conversation; the offsets hold the escaped text."""
    out, at = [], 0
    while at < len(formatted):
        head = _HEAD.match(formatted, at)
        body = head and _BODY.match(formatted, head.end())
        if not body:
            raise ValueError(f"not a formatted conversation at {at}")
        role = _NAMES.get(head[1]) or unescape(head[2])
        out.append((role, unescape(body[1]), body.start(1), body.end(1)))
        at = body.end()
    return out


def loss_spans(formatted: str) -> list[tuple[int, int]]:
    """Where a model is trained: the assistant texts (still escaped)."""
    return [(a, b) for role, _, a, b in parse(formatted) if role == "assistant"]


def fold(log: DataFrame) -> DataFrame:
    """Final turns ``conv_id, turn, first, role, text`` of an event log."""
    pos = F.struct("seq", "kind", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ev = log.select("conv_id", "turn", "kind", pos.alias("ev"))
    keys = ["conv_id", "turn"]
    last = ev.where("kind <> 'delta'").groupBy(*keys).agg(F.max("ev").alias("reset"))
    same = F.col("l.conv_id").eqNullSafe(F.col("e.conv_id")) & F.col("l.turn").eqNullSafe(F.col("e.turn"))
    live = (ev.alias("e").join(last.alias("l"), same, "left")
            .where("reset is null or e.ev >= reset").where("reset is null or reset.kind <> 'delete'")
            .select("e.conv_id", "e.turn", "ev"))
    # a regenerate carries no text of its own; an event delivered twice counts once
    piece = F.when(F.col("ev.kind") == "regenerate", F.lit("")).otherwise(F.col("ev.text"))
    return (live.distinct().withColumn("part", F.struct("ev", piece.alias("t")))
            .groupBy(*keys).agg(F.array_sort(F.collect_list("part")).alias("parts"))
            .select(*keys, F.col("parts")[0]["ev"]["seq"].alias("first"), F.col("parts")[0]["ev"]["role"].alias("role"),
                    F.concat_ws("", F.transform("parts", lambda p: p["t"])).alias("text")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, formatted`` of final turns ``conv_id, turn, first, role, text``."""
    @F.pandas_udf("string")
    def rendered(col: pd.Series) -> pd.Series:
        return col.map(lambda ts: render([(t["role"], t["text"]) for t in ts]))

    t = F.struct("turn", "first", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(t)).alias("ts"))
            .select("conv_id", rendered("ts").alias("formatted")))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests taken from the formatted text alone."""
    kinds = "struct<n_turns:bigint,turns_sha256:string,loss_chars:bigint,loss_sha256:string,formatted_chars:bigint>"

    @F.pandas_udf(kinds)
    def digests(col: pd.Series) -> pd.DataFrame:
        rows = []
        for s in col:
            turns, loss, whole = parse(s), [], hashlib.sha256()
            for role, text, a, b in turns:
                whole.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for a, b in loss_spans(s):
                loss.append(unescape(s[a:b]))
            loss = "".join(loss)
            rows.append((len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(s)))
        return pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.withColumn("d", digests("formatted")).select("conv_id", "d.*")


def from_turns(conv: DataFrame) -> DataFrame:
    """An event log for a plain table of turns: every row is one ``message`` of its own turn.

    Rows that share a conversation and a turn number stay separate: they become
    turns ``(turn, 0), (turn, 1), ..`` in the order of role and text.
    """
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return (conv.select("conv_id", "turn", "role", "text")
            .withColumn("turn", F.struct("turn", F.row_number().over(w).alias("tie")))
            .select("conv_id", "turn", F.lit(0).cast("bigint").alias("seq"), F.lit("message").alias("kind"), "role", "text"))


def event_log(conv: DataFrame, piece: int = 256) -> DataFrame:
    """An event log that leads to the turns of a plain table, as a chat service would have written it.

    A hash of conversation and turn deals the turns into six histories: one message; a wrong draft
    and its edit; a text streamed in deltas; a draft whose streaming was broken off, then regenerated, with the last
    delta delivered twice; a draft that was deleted and sent again; and a message beside a turn of its own
    that was streamed, edited and deleted.  Drafts and deleted turns leave no trace in the fold.  A text is cut into pieces of
    ``piece`` code points, or into 64 where it is longer than those hold.
    """
    rows = from_turns(conv).select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    n = F.length("text")
    size = F.greatest(F.lit(piece), F.ceil(n / 64).cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / size).cast("int") - 1, F.lit(0)))
    draft = F.concat(F.reverse(F.substring("text", 1, 40)), F.lit(" \\### draft"))

    def event(seq, kind, text, ghost=False):
        return F.struct(F.lit(ghost).alias("ghost"), F.lit(seq).cast("bigint").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))

    def deltas(first):
        return F.transform(starts, lambda i: F.struct(
            F.lit(False).alias("ghost"), (i + first).cast("bigint").alias("seq"), F.lit("delta").alias("kind"), F.substring(F.col("text"), i * size + 1, size).alias("text")))

    none = F.lit("")
    whole = event(0, "message", F.col("text"))
    streamed = F.array_append(deltas(10), F.element_at(deltas(10), -1))
    histories = [
        F.array(whole),
        F.array(event(0, "message", draft), event(1, "edit", F.col("text"))),
        F.concat(F.array(event(0, "message", none)), deltas(1)),
        F.concat(F.array(event(0, "message", none), event(1, "delta", draft), event(2, "regenerate", none)), streamed),
        F.concat(F.array(event(0, "message", draft), event(1, "delete", none), event(2, "message", none)), deltas(10)),
        F.array(whole, event(0, "message", none, True), event(1, "delta", draft, True), event(2, "edit", draft, True), event(3, "delete", none, True)),
    ]
    dealt = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(histories)))
    events = histories[0]
    for k, h in enumerate(histories[1:], 1):
        events = F.when(dealt == k, h).otherwise(events)
    ghost = F.struct(F.col("turn.turn").alias("turn"), (-F.col("turn.tie")).alias("tie"))
    return (rows.select("conv_id", "turn", "role", F.explode(events).alias("e"))
            .select("conv_id", F.when(F.col("e.ghost"), ghost).otherwise(F.col("turn")).alias("turn"), "e.seq", "e.kind", "role", "e.text"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations (and -7, full of control strings): their event log folded, rendered and read back."""
    odd = "\\### Assistant: </turn> ok"
    extra = local_table(spark, [(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return read_back(format_conversations(fold(event_log(conv))))
