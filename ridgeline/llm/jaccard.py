"""N-gram Jaccard join: rare-first prefix filtering with exact verification.

A document's set holds its distinct word shingles (the whole sequence when it has
fewer words; nothing without words).  Documents link when
``100 * |A & B| >= percent * |A | B|``.

1. Documents with the same set are one class (they link at 100 %); the join runs on classes.
2. Rare first: every set is ordered by (estimated document frequency, hash).  The
   frequency comes from a table of ``COUNTERS`` counters over all shingles (size fixed, 1 MB
   as broadcast); any fixed order gives the right result, a rare-first one short lists.
3. Prefix filter: two sets that link share a shingle among the first
   ``n - ceil(t n) + 1`` of each.  Prefix shingles are the join key.
4. Length filter ``100 m >= percent n`` for the smaller size m; positional filter: a
   common shingle at places i, j leaves at most ``1 + min(n-i-1, m-j-1)`` common ones.
5. Suffix filter: the sets' counts in 64 hash ranges bound the symmetric difference.
6. What is left is verified once per pair, exactly, on the two sorted hash arrays.

Hot lists: a shingle's list is never gathered.  In a pivot round each list
names one pivot (the member with most copies) by an aggregate, and every
other member is paired with it: linear in the list.  Linked classes merge.
Members of one component need no more tests among themselves, lists
with one component left are done, and the next round picks another pivot.  After
``PIVOT_ROUNDS`` rounds all pairs of a list that are still in different
components and pass the filters are tested, each at its first common shingle only: so no link
between components is missed, and components equal those of the full join.

Links (``jaccard_links``): every link lies inside a component, so the number of links per row comes
from all pairs of a component's classes, each verified once.  A component's classes are dealt into
blocks of about ``BLOCK``; every two blocks meet in one task, which holds their texts and sends back sums per
class.  So no pair becomes a row, and a large group is spread over as many tasks as it has pairs of blocks.
Exact copies link by multiplicity, a row not with itself.

Null and empty texts, and texts of white space, have empty sets: each is its own
component.  Rows with a null id keep a null component unless they link with an id.
Repeated rows come back each.  Extra columns are ignored.  Shingles and classes are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, lower_words, parts, shingle_hashes, stash, table, word_hashes

COUNTERS = 1 << 18
CHUNK = 1 << 12
PIVOT_ROUNDS = 2
RANGES = 64
BLOCK = 128  # classes of a component that meet those of another block in a task, about


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return np.unique(shingle_hashes(word_hashes(lower_words(text)), n))


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(46)).astype(np.int64)


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def _range_counts(s: np.ndarray) -> bytes:
    """Elements per hash range; clipped counts bound the difference of two sets from below all the same."""
    n = np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=RANGES)
    return np.minimum(n, 65535).astype("<u2").tobytes()


_FIRST = "chunk int, counts binary, id {id}, rid string, cls bigint, n bigint, ranges binary"


def _first_pass(texts: DataFrame, shingle: int) -> tuple[DataFrame, np.ndarray]:
    """``(rows, counters)``: class, size and range counts of every row, and the occurrence counters of all shingles.

    Both come from one reading of the texts; each task sends its counters as one blob per chunk.
    """
    id_type = dict(texts.dtypes)["id"]
    id_arrow = texts.select("id").limit(0).toArrow().schema.field("id").type
    names = ["chunk", "counts", "id", "rid", "cls", "n", "ranges"]

    def read(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(COUNTERS, np.int64)
        for b in parts(batches):
            cls, size, ranges, held, waiting = [], [], [], [], 0
            for t in b.column(2):
                s = shingle_set(t.as_py(), shingle)
                cls.append(xxhash.xxh3_64_intdigest(s.tobytes()))
                size.append(len(s))
                ranges.append(_range_counts(s))
                held.append(s)
                waiting += len(s)
                if waiting > 1 << 20:
                    total += np.bincount(_slot(np.concatenate(held)), minlength=COUNTERS)
                    held, waiting = [], 0
            if waiting:
                total += np.bincount(_slot(np.concatenate(held)), minlength=COUNTERS)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), b.column(0), b.column(1), pa.array(np.array(cls, np.uint64).view(np.int64)),
                 pa.array(size, pa.int64()), pa.array(ranges, pa.binary())], names=names)
        part = total.reshape(-1, CHUNK)
        keep = np.flatnonzero(part.any(1))
        k = len(keep)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keep, pa.int32()), pa.array([part[c].astype("<i8").tobytes() for c in keep], pa.binary()), pa.nulls(k, id_arrow),
             pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary())], names=names)

    def add(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[k] = sums.get(k, 0) + np.frombuffer(v, "<i8")
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "counts"])

    both = stash(texts.mapInArrow(read, _FIRST.format(id=id_type)))
    blobs = both.where("chunk is not null").select("chunk", "counts")
    out = np.zeros((COUNTERS // CHUNK, CHUNK), np.int64)
    for r in blobs.repartition(COUNTERS // CHUNK, "chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], "<i8")
    counters = np.minimum(out.reshape(-1), np.iinfo(np.int32).max).astype(np.int32)
    return both.where("chunk is null").select("id", "rid", "cls", "n", "ranges"), counters


def _rare_first(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return s[np.lexsort((s, counts[_slot(s)]))]


def _key(text: str) -> F.Column:
    return F.md5(F.coalesce(F.col(text), F.lit(""))).alias("rid")


BROADCAST_KEYS = 1_000_000  # text keys (md5, class) sent to every executor at most, about 100 MB


def _small(df: DataFrame) -> DataFrame:
    """A written key table, marked for broadcast when it has at most ``BROADCAST_KEYS`` rows."""
    df = stash(df)
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def _at(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``left`` joined with ``right`` on text key and (null-safe) id; columns of ``left`` and the rest of ``right``."""
    r = right.withColumnsRenamed({"id": "_rid_id", "rid": "_rid_key"})
    out = left.join(r, (F.col("rid") == F.col("_rid_key")) & F.col("id").eqNullSafe(F.col("_rid_id")), how)
    return out.drop("_rid_id", "_rid_key")


def link_classes(texts: DataFrame, percent: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(members, labels, classes)`` of a frame with columns ``id`` and ``text``.

    members: ``id, rid, cls, n`` per row; labels: ``cls, comp`` for the classes that link with another;
    classes: ``cls, copies, one`` (and filter columns) per class with shingles.
    """
    spark = texts.sparkSession
    texts = texts.select("id", _key("text"), "text")
    rows, counters = _first_pass(texts, shingle)
    shared = spark.sparkContext.broadcast(counters)
    members = rows.select("id", "rid", "cls", "n")
    classes = stash(rows.where("n > 0").groupBy("cls").agg(
        F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("ranges").alias("ranges"), F.min(F.struct("rid", "id")).alias("one")))
    # rows of classes with copies: one of them stands for the class
    multi = classes.where("copies > 1").select("cls", "copies", "one")
    marks = members.join(multi, "cls").select("id", "rid", "copies", ((F.col("one.rid") == F.col("rid")) & F.col("one.id").eqNullSafe(F.col("id"))).alias("stands"))
    marked = _at(texts, _small(marks.distinct()), "left").where("coalesce(stands, true)")

    def prefix(batches: Iterator[pa.RecordBatch]):
        for b in parts(batches):
            key, cls, size, place, many = [], [], [], [], []
            for t, k in zip(b.column(0), b.column(1).to_pylist()):
                s = shingle_set(t.as_py(), shingle)
                if len(s):
                    p = _rare_first(s, shared.value)[:prefix_size(len(s), percent)]
                    key.append(p >> np.uint64(16))
                    cls.append(np.full(len(p), xxhash.xxh3_64_intdigest(s.tobytes()), np.uint64))
                    size.append(np.full(len(p), len(s), np.int32))
                    place.append(np.arange(len(p), dtype=np.int32))
                    many.append(np.full(len(p), min(k, 1 << 20), np.int32))
            if key:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(key).view(np.int64)), pa.array(np.concatenate(cls).view(np.int64)), pa.array(np.concatenate(size)),
                     pa.array(np.concatenate(place)), pa.array(np.concatenate(many))], names=["key", "cls", "n", "i", "copies"])

    # 48 bits of the shingle are enough for a join key: a clash is one more candidate
    posts = marked.select("text", F.coalesce("copies", F.lit(1)).alias("copies")).mapInArrow(prefix, "key bigint, cls bigint, n int, i int, copies int")
    alive = posts.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("key")
    posts = stash(posts.join(alive, "key", "left_semi"))
    edges, labels = None, None
    for step in range(PIVOT_ROUNDS + 1):
        here = posts.withColumn("c", F.col("cls")) if labels is None else posts.join(
            labels.withColumnRenamed("comp", "c"), "cls", "left").withColumn("c", F.coalesce("c", "cls"))
        # the most copied member first; then members drawn alike in all lists
        mixed = F.pmod(F.xxhash64("cls", F.lit(step)), F.lit(1 << 40))
        draw = F.col("copies").cast("bigint") * (1 << 40) + mixed if step == 0 else mixed
        here = here.withColumn("draw", draw)
        lists = here.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"),
                                        *[F.max_by(v, "draw").alias(v) for v in ("cls", "n", "i", "c")]).where("lo < hi")
        if step < PIVOT_ROUNDS:
            left = lists.select("key", "cls", "n", "i", "c")
        else:
            # a member too far behind to link with any partner of the list's sizes leaves it
            least = here.groupBy("key").agg(F.min("n").alias("low"))
            open_ = lists.select("key").join(least, "key")
            partner = F.greatest(F.col("low"), F.ceil(F.col("n") * percent / F.lit(100)))
            enough = (100 + percent) * (F.col("n") - F.col("i")) >= percent * (F.col("n") + partner)
            # every pair once, at its first common key, where the positional filter is sharpest: each member
            # carries its own earlier keys (at most a prefix), and lists that share an earlier one pass
            here = stash(here.join(open_, "key").where(enough).select("key", "cls", "n", "i", "c"))
            own = here.groupBy("cls").agg(F.collect_list(F.struct("i", "key")).alias("own"))
            here = (here.join(own, "cls").withColumn("before", F.expr("transform(filter(own, x -> x.i < i), x -> x.key)"))
                    .select("key", "cls", "n", "i", "c", "before"))
            left = here
        a, b = left.alias("a"), here.alias("b")
        both = F.col("a.n") + F.col("b.n")
        need = F.ceil(both * percent / F.lit(100 + percent))
        room = 1 + F.least(F.col("a.n") - F.col("a.i") - 1, F.col("b.n") - F.col("b.i") - 1)
        on = ((F.col("a.key") == F.col("b.key")) & (F.col("a.c") != F.col("b.c")) & (F.col("a.cls") != F.col("b.cls"))
              & (100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")) & (room >= need))
        if step == PIVOT_ROUNDS:
            on = on & (F.col("a.cls") < F.col("b.cls")) & ~F.arrays_overlap("a.before", "b.before")
        pairs = a.join(b, on)
        pairs = stash(pairs.select(F.col("a.cls").alias("x"), F.col("b.cls").alias("y")).distinct())
        found = _verify(pairs, classes, texts, percent, shingle)
        edges = found if edges is None else edges.union(found)
        labels = components(edges).select(F.col("node").alias("cls"), "comp")
    return members, labels, classes


def _verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The pairs ``(x, y)`` of classes that link, as edges ``(a, b)``: suffix filter, then the exact sets.

    x is the side with fewer different classes (pivots): its sets travel once per class, those of y with their pairs.
    """
    side = lambda c: classes.select(F.col("cls").alias(c), F.col("ranges").alias(f"r{c}"), F.col("n").alias(f"n{c}"))
    with_r = pairs.join(side("x"), "x").join(side("y"), "y")

    def near(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if not b.num_rows:
                continue
            rx, ry = (np.stack([np.frombuffer(v, "<u2") for v in b.column(k).to_pylist()]).astype(np.int64) for k in ("rx", "ry"))
            n = b.column("nx").to_numpy() + b.column("ny").to_numpy()
            apart = np.abs(rx - ry).sum(1)
            # common = (n - apart) / 2 at most, and union = n - common
            ok = (100 + percent) * (n - apart) >= 2 * percent * n
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], names=["x", "y"]).filter(pa.array(ok))

    left = stash(with_r.mapInArrow(near, "x bigint, y bigint"))

    def sets_of(c):
        one = classes.join(left.select(F.col(c).alias("cls")).distinct(), "cls", "left_semi").select("cls", "one.id", "one.rid")

        def sets(batches: Iterator[pa.RecordBatch]):
            for b in parts(batches):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([shingle_set(t.as_py(), shingle).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))],
                    names=[c, f"s{c}"])

        return _at(texts, _small(one), "inner").select("cls", "text").mapInArrow(sets, f"{c} bigint, s{c} array<bigint>")

    def same(batches: Iterator[pa.RecordBatch]):
        for b in parts(batches):
            ok = []
            for p, q in zip(b.column("sx"), b.column("sy")):
                p, q = (np.asarray(v.values).view(np.uint64) for v in (p, q))
                common = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    full = left.join(sets_of("y"), "y").join(sets_of("x"), "x")
    return stash(full.mapInArrow(same, "a bigint, b bigint").distinct())


def _pair_sums(cls: list[int], sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray, percent: int) -> np.ndarray:
    """Rows that every class links with among the pairs of sides 0 and 1 (all pairs when there is one side)."""
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(place, kind="stable")
    owner = owner[order]
    ends = np.cumsum(np.bincount(place, minlength=len(values)))
    k = len(cls)
    common = np.zeros((k, k), np.int32)
    for p, q in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()):
        if q - p > 1:
            who = owner[p:q]
            common[np.ix_(who, who)] += 1
    n = np.array([len(s) for s in sets])
    link = 100 * common.astype(np.int64) >= percent * (n[:, None] + n[None, :] - common)
    link &= ~np.eye(k, dtype=bool)
    if side.any() and not side.all():
        link &= side[:, None] != side[None, :]
    return link.astype(np.int64) @ copies


def class_links(texts: DataFrame, labels: DataFrame, classes: DataFrame, percent: int, shingle: int) -> DataFrame:
    """``cls, far``: rows of other classes that a class links with, from every pair of a component's classes once."""
    texts = texts.select("id", _key("text"), "text")
    big = labels.groupBy("comp").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BLOCK)
    big = _small(big.select("comp", F.ceil(F.col("k") / BLOCK).cast("int").alias("blocks")))
    # block p meets every block q: a class of block b goes to (b, q) for q >= b and to (p, b) for p < b
    dealt = (labels.join(big, "comp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
             .withColumn("b", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("blocks")).cast("int")))
    one = dealt.join(classes.select("cls", "copies", "one"), "cls").select("cls", "one.id", "one.rid", "comp", "copies", "blocks", "b")
    held = _at(texts, _small(one), "inner").select("cls", "comp", "copies", "blocks", "b", "text").dropDuplicates(["cls"])
    met = (held.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("comp", F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "cls", "copies", "text"))

    def links(group: pa.Table) -> pa.Table:
        cls, b, p = (group.column(c).to_pylist() for c in ("cls", "b", "p"))
        sets = [shingle_set(t.as_py(), shingle) for t in group.column("text")]
        pairs_of = group.column("q")[0].as_py() != p[0]
        side = np.array([x != p[0] for x in b])
        far = np.zeros(len(cls), np.int64)
        if not pairs_of or (side.any() and not side.all()):
            far = _pair_sums(cls, sets, group.column("copies").to_numpy().astype(np.int64), side, percent)
        return pa.table({"cls": pa.array(cls, pa.int64()), "far": pa.array(far, pa.int64())})

    sums = met.groupBy("comp", "p", "q").applyInArrow(links, "cls bigint, far bigint")
    return stash(sums.where("far > 0").groupBy("cls").agg(F.sum("far").alias("far")))


def _rows(members: DataFrame, labels: DataFrame, *more: str) -> DataFrame:
    """Per row: ``id, rid, n_shingles, component_id`` and the columns ``more`` of ``labels``."""
    rows = members.join(labels, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    least = rows.where("n > 0").groupBy("comp").agg(F.min("id").alias("first"))
    return (rows.join(least, "comp", "left")
            .select("id", "rid", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id")).alias("component_id"), *more))


def jaccard_groups(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``id, rid`` (md5 of the text)``, n_shingles, component_id`` (smallest id of the component)."""
    members, labels, _ = link_classes(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text")), percent, shingle)
    return _rows(members, labels)


def jaccard_links(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """As :func:`jaccard_groups`, with ``n_links``: the other rows that a row links with (0 without shingles)."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    members, labels, classes = link_classes(texts, percent, shingle)
    per_class = (classes.select("cls", "copies").join(labels, "cls", "left").join(class_links(texts, labels, classes, percent, shingle), "cls", "left")
                 .select("cls", F.coalesce("comp", "cls").alias("comp"), (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("links")))
    return _rows(members, per_class, "links").withColumn("n_links", F.coalesce("links", F.lit(0)).cast("bigint")).drop("links")


def keep_one(docs: DataFrame, percent: int = 80, shingle: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked documents (the smallest id, null last), columns unchanged.

    Rows without shingles all stay.  Rows with equal id and text are one document given
    twice; rows that share an id but no link are different documents.
    """
    pick = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text}`").alias("text"))
    members, labels, _ = link_classes(pick, percent, shingle)
    rows = stash(members.where("n > 0").join(labels, "cls", "left").select("id", "rid", F.coalesce("comp", "cls").alias("comp")))
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rid")).alias("w"), F.count(F.lit(1)).alias("k"))
    groups = rows.join(first.where("k > 1"), "comp")
    wins = F.col("w.id").eqNullSafe(F.col("id")) & (F.col("w.rid") == F.col("rid"))
    judged = _small(groups.groupBy("id", "rid", wins.alias("wins")).agg(F.count(F.lit(1)).alias("k")).where("k > 1 or not wins"))
    same = F.col("_id").eqNullSafe(F.col("j.id")) & (F.col("_rid") == F.col("j.rid"))
    name = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    safe = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in name.items()])
    safe = safe.withColumns({"_id": F.col(name[id_col]), "_rid": F.md5(F.coalesce(F.col(name[text]), F.lit("")))})
    plain = safe.join(judged.alias("j"), same, "left_anti")
    again = safe.join(judged.where("wins").alias("j"), same, "left_semi").dropDuplicates(["_id", "_rid"])
    return plain.unionByName(again).select(*[F.col(n).alias(c) for c, n in name.items()])


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the 85 % Jaccard join on 4-word shingles over all documents."""
    out = jaccard_groups(table(spark, sf_dir, "documents"), percent=85, shingle=4)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op8_jaccard``, with the number of other documents that each links with."""
    out = jaccard_links(table(spark, sf_dir, "documents"), percent=85, shingle=4)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")
