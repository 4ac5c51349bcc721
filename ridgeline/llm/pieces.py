"""SentencePiece encoding and decoding with an Aho-Corasick driven Viterbi pass.

The pieces and their scores come from a given SentencePiece model (never trained
here).  An Aho-Corasick automaton over all normal pieces reads the text once; at
every position its output links yield each piece that ends there, and each such
piece relaxes the best score of the position behind it.  A character that no piece
covers costs ``min score - 10`` and becomes its UTF-8 bytes (byte fallback).

A space becomes U+2581 and one is put in front; a U+2581 that is already in the
text goes through byte fallback, so ``decode(encode(x)) == x`` for every text.

No piece has a U+2581 after another character, and none has a character of
``separators``, so the best path always has a cut there: the pass runs over such
chunks, and chunks seen before are looked up (two generations of ``CACHE`` entries).

Null texts give null ids; empty texts an empty list.  Row by row: repeated rows,
ties and null ids need no rule.  Between equally good paths the one whose
last piece is longest wins.
Very long texts are values like others: they are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, parts, table

SPACE = "\u2581"
HELD = "\ud800"  # stands for a U+2581 of the text; cannot occur in valid UTF-8
CACHE = 150_000
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


class PieceCodec:
    """Encoder and decoder over the bytes of one SentencePiece model."""

    def __init__(self, model: bytes):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        normal = [i for i in range(len(self.pieces)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if sp.is_byte(i)}
        if len(self.byte_id) != 256:
            raise ValueError("the model needs byte fallback")
        self.of_byte = {i: b for b, i in self.byte_id.items()}
        self.normal = set(normal)
        self.spelling = [self.pieces[i].replace(SPACE, " ").encode() if i in self.normal else bytes([self.of_byte[i]])
                         if i in self.of_byte else b"" for i in range(len(self.pieces))]
        # the automaton yields (id, length, score); id None: a character without a piece, written as bytes
        self.unknown = min(sp.get_score(i) for i in normal) - 10.0
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i]), sp.get_score(i)))
        self.alphabet = set().union(*(self.pieces[i] for i in normal))
        for c in self.alphabet - {self.pieces[i] for i in normal}:
            self.automaton.add_word(c, (None, 1, self.unknown))
        self.automaton.make_automaton()
        if any(re.search(f"[^{SPACE}]{SPACE}", self.pieces[i]) for i in normal):
            raise ValueError("a piece has a space after another character")
        cut = re.escape("".join(c for c in "\n\r\t\0" + HELD if c not in self.alphabet))
        self.chunks = re.compile(f"[{cut}]|{SPACE}*[^{SPACE}{cut}]+|{SPACE}+").findall
        self.young: dict[str, list[int]] = {}
        self.old: dict[str, list[int]] = {}

    def _bytes(self, c: str) -> list[int]:
        return [self.byte_id[b] for b in (SPACE if c == HELD else c).encode("utf-8", "surrogatepass")]

    def viterbi(self, s: str) -> list[int]:
        """Ids of the best path through characters that all are in the alphabet."""
        best = [0.0] + [-1e300] * len(s)
        back = best[:]
        for end, hit in self.automaton.iter(s):
            end += 1
            at = best[end - hit[1]] + hit[2]
            if at > best[end]:
                best[end] = at
                back[end] = hit
        out, at = [], len(s)
        while at:
            i, size, _ = back[at]
            at -= size
            if i is None:
                out += reversed(self._bytes(s[at]))
            else:
                out.append(i)
        out.reverse()
        return out

    def _chunk(self, s: str) -> list[int]:
        """Ids of a chunk; no piece covers a character outside the alphabet, so the path is cut there."""
        if self.alphabet.issuperset(s):
            return self.viterbi(s)
        out, run = [], 0
        for k, c in enumerate(s):
            if c not in self.alphabet:
                out += self.viterbi(s[run:k]) + self._bytes(c)
                run = k + 1
        return out + self.viterbi(s[run:])

    def _fresh(self, s: str) -> list[int]:
        """Ids of a chunk that is not among the young; two generations keep the frequent ones."""
        ids = self.old.get(s)
        if ids is None:
            ids = self._chunk(s)
        if len(s) <= 64:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[s] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        get, fresh, out = self.young.get, self._fresh, []
        for c in self.chunks(SPACE + text.replace(SPACE, HELD).replace(" ", SPACE)):
            ids = get(c)
            if ids is None:
                ids = fresh(c)
                get = self.young.get
            out += ids
        return out

    def decode(self, ids) -> str:
        """The text of piece ids; bytes that are no UTF-8 become U+FFFD."""
        raw = b"".join(map(self.spelling.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def read_model(path: str = DEFAULT_MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


_CODECS: dict[str, PieceCodec] = {}


def codec(model: bytes) -> PieceCodec:
    """One codec per task and model."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = PieceCodec(model)
    return _CODECS[key]


MODEL_LIMIT = 16 << 20


def _shared_model(spark: SparkSession, path: str):
    model = read_model(path)
    if len(model) > MODEL_LIMIT:
        raise ValueError(f"{path} has {len(model)} bytes; the broadcast is bounded by {MODEL_LIMIT}")
    return spark.sparkContext.broadcast(model)


def _by_batch(df: DataFrame, add: dict[str, str], fn) -> DataFrame:
    """``df`` with further columns: ``fn(batch) -> list of arrays``, Arrow batches in tasks."""
    for c in add:
        if c in df.columns:
            raise ValueError(f"column {c} is already there")
    schema = df.limit(0).selectExpr("*", *[f"cast(null as {t}) as `{c}`" for c, t in add.items()]).schema

    def run(batches: Iterator[pa.RecordBatch]):
        for b in parts(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, *fn(b)], names=[*b.schema.names, *add])
        _CODECS.clear()  # Python workers outlive the task: the next one needs the automaton's memory
        give_back()

    return df.mapInArrow(run, schema)


def encode_frame(df: DataFrame, text: str = "text", ids: str = "piece_ids", path: str = DEFAULT_MODEL) -> DataFrame:
    """``df`` with the array of piece ids of ``text``."""
    shared, k = _shared_model(df.sparkSession, path), df.columns.index(text)

    def fn(b):
        c = codec(shared.value)
        return [pa.array([None if (t := x.as_py()) is None else c.encode(t) for x in b.column(k)], pa.list_(pa.int32()))]

    return _by_batch(df, {ids: "array<int>"}, fn)


def decode_frame(df: DataFrame, ids: str = "piece_ids", text: str = "decoded", path: str = DEFAULT_MODEL) -> DataFrame:
    """``df`` with the text of the piece ids."""
    shared, k = _shared_model(df.sparkSession, path), df.columns.index(ids)

    def fn(b):
        c = codec(shared.value)
        return [pa.array([None if (v := x.as_py()) is None else c.decode(v) for x in b.column(k)], pa.string())]

    return _by_batch(df, {text: "string"}, fn)


def encode_and_check(docs: DataFrame, cols: list[str], text: str = "text", path: str = DEFAULT_MODEL) -> DataFrame:
    """``cols`` with ``piece_ids``, ``n_pieces``, ``n_byte_pieces`` and whether decoding gave the text back (``round_trip``)."""
    given = docs.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").alias("_encoded"))
    shared = _shared_model(docs.sparkSession, path)

    def fn(b):
        c, ids, n, fell, same = codec(shared.value), [], [], [], []
        for x in b.column(b.num_columns - 1):
            t = x.as_py()
            v = None if t is None else c.encode(t)
            ids.append(v)
            n.append(0 if v is None else len(v))
            fell.append(0 if v is None else sum(map(c.of_byte.__contains__, v)))
            same.append(t is None or c.decode(v) == t)
        return [pa.array(ids, pa.list_(pa.int32())), pa.array(n, pa.int64()), pa.array(fell, pa.int64()), pa.array(same, pa.bool_())]

    out = _by_batch(given, {"piece_ids": "array<int>", "n_pieces": "bigint", "n_byte_pieces": "bigint", "round_trip": "boolean"}, fn)
    return out.drop("_encoded")


def op10_pieces(spark: SparkSession, sf_dir: str, path: str = DEFAULT_MODEL) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text back."""
    return encode_and_check(table(spark, sf_dir, "documents"), ["doc_id"], path=path)
