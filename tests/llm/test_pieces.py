import random
from collections import Counter

import pytest

from ridgeline.llm import pieces as P


@pytest.fixture(scope="module")
def codec():
    return P.PieceCodec(P.read_model())


def best_score(codec, s):
    """Score of the best segmentation, by trying every piece at every place."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=P.DEFAULT_MODEL)
    score = {codec.pieces[i]: sp.get_score(i) for i in codec.normal}
    unknown = min(score.values()) - 10
    best = [0.0]
    for e in range(1, len(s) + 1):
        best.append(max([best[e - 1] + unknown] + [best[b] + score[s[b:e]] for b in range(max(0, e - 16), e) if s[b:e] in score]))
    return best[-1], score, unknown


TEXTS = ["", " ", "  ", "hello world", " lead", "trail ", "a  b   c", "line\nline\r\n\ttab", "▁ kept ▁▁", "日本語 ﬁ \u0000 é \U0001F600 z",
         "a" * 500, "\n", "x\ny", "�", "é"]


def test_round_trip(codec):
    rnd = random.Random(7)
    texts = TEXTS + ["".join(rnd.choice("ab \n▁é日\U0001F600t\u0000") for _ in range(rnd.randint(0, 40))) for _ in range(500)]
    for t in texts:
        assert codec.decode(codec.encode(t)) == t


def test_viterbi_is_optimal(codec):
    rnd = random.Random(3)
    for t in ["hello world again", "the quick brown fox", "zzzzqqqq", "aé日b"] + ["".join(rnd.choice("etaoin sr日") for _ in range(30)) for _ in range(40)]:
        s = P.SPACE + t.replace(" ", P.SPACE)
        want, score, unknown = best_score(codec, s)
        ids, got, run = codec.encode(t), 0.0, bytearray()
        for i in ids:
            if i in codec.of_byte:
                run.append(codec.of_byte[i])
            else:
                got += score[codec.pieces[i]]
        got += unknown * len(run.decode())
        assert abs(got - want) < 1e-6


def test_frames(docs, rows, none):
    enc = P.encode_frame(docs)
    out = P.decode_frame(enc)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter((r[0], r[1]) for r in rows)
    assert all(r["decoded"] == r["text"] for r in out.collect())
    both = P.encode_and_check(docs, ["doc_id"]).collect()
    assert len(both) == len(rows) and all(r["round_trip"] for r in both)
    assert [r["n_pieces"] for r in both if r["piece_ids"] is None] and P.encode_and_check(none, ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        P.encode_frame(docs, ids="key")
