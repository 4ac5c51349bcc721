import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from ridgeline.llm import merkle as M
from ridgeline.llm.twins import MERKLE

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, leaf string, root int, pos string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return hashlib.sha256(b"".join(b"-" if v is None else b"%d:%s" % (len(str(v).encode()), str(v).encode()) for v in r)).hexdigest()


def tree(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        lo = i // 16 * 16
        out.append(("".join(nodes[lo:i]), "".join(nodes[i + 1:lo + 16])))
        i //= 16
    return out


def brute(rows):
    """The contract, node by node."""
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0], leaf(r), r))
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[1] for x in sorted(groups[k], key=key)]) for k in order}
    top = tree([trees[k][-1][0] for k in order])
    out = []
    for j, k in enumerate(order):
        for i, (doc, node, r) in enumerate(sorted(groups[k], key=key)):
            p = path(trees[k], i) + path(top, j)
            now = node
            if doc is not None and zlib.crc32(str(doc).encode()) % 5 == 0 and r[4] is not None:
                now = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in p:
                now = h(a + now + b)
            out.append((doc, node, trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in p)), now, now == top[-1][0]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def run(docs):
    hit = M.F.crc32(M.F.col("doc_id").cast("string")) % 5 == 0
    return M.prove(M.leaves_of(docs, hit, M.F.translate("text", M._UPPER, M._LOWER)))


def odd_rows():
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(60)]
    rows += [(None, None, None, None, None), (None, None, None, None, None), (7, "é", "fr", 0, ""), (8, "", None, 5, "A" * 3_000_000),
             (3, "s0", "en", 3, "Text 3"), (-4, "s1", "日本", None, "ÀÉ z\u0000")]
    return rows


def test_addresses_fill_the_tree_once():
    for levels in range(1, 5):
        seen = np.concatenate([M.address(levels, d, np.arange(16 ** d)) for d in range(levels)])
        assert sorted(seen) == list(range(M.tree_size(levels)))
    # four levels: the upper two come first, then every lower subtree of two levels in one piece
    assert sorted(np.concatenate([M.address(4, d, np.arange(16 ** d)) for d in (0, 1)])) == list(range(17))
    low = np.concatenate([M.address(4, 2, np.array([3])), M.address(4, 3, np.arange(48, 64))])
    assert sorted(low) == list(range(17 + 3 * 17, 17 + 4 * 17))


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 256, 257, 600])
def test_stored_block_equals_plain_tree(n):
    leaves = [hashlib.sha256(b"%d" % i).digest() for i in range(n)]
    height = M.block_levels(n, n)
    t = M.Subtree(M.build(leaves, height), n, height)
    want = tree([x.hex() for x in leaves])
    assert t.level == want and all(t.path(i) == path(want, i) for i in range(n))


def test_odd_rows_equal_brute_force(spark):
    rows = odd_rows()
    docs = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    assert got(run(docs)) == got(run(docs.repartition(7))) == brute(rows)


def test_group_of_several_blocks_and_many_groups(spark):
    rows = [(i, "hot", "en", i, f"T{i}") for i in range(9000)] + [(i, f"g{i}", "en", 1, "One") for i in range(4300)]
    docs = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA).repartition(6)
    assert got(run(docs)) == brute(rows)


def test_tampering_is_found(spark):
    docs = spark.createDataFrame([(*r, None, None, None) for r in odd_rows()], SCHEMA)
    out = {(r["doc_id"], r["verified"]) for r in run(docs).collect()}
    assert {d for d, ok in out if not ok} == {d for d in range(60) if zlib.crc32(b"%d" % d) % 5 == 0}


def test_empty(spark):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_twin(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got(M.op13_merkle(spark, sf)) == sorted(con.execute(MERKLE).fetchall(), key=str)
