"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function gives each document the set of its shingle hashes, the k
smallest of which are its sketch.  Documents with equal sets form a class, and
only classes are compared.

Two sets with Jaccard similarity t share each of the k smallest values of their
union with probability t, so their sketches have at least ``floor`` values in
common unless a binomial tail of at most ``MISS`` is hit.  With the sketch values
of a document in order from rare to frequent, two such documents share one of
the first k - floor + 1.  Inverted lists of just these values therefore find
every link, and a value that very many documents hold matters only to
documents that consist of such values.

Within a list no pairs are enumerated: its most central member, the one whose values
are the most frequent, is compared with the others, after which lists with the
same centre are one and linked members are one component.  Pairs that pass the
union-sketch estimate are verified on the full sets.  Where the members of a
centre are then in several components, those outside the largest are dealt into
blocks and the sketches of each block are compared with those of blocks of all members.
Full sets go only to the pairs of blocks, and there only of the members, whose estimate
asks for it; a pair of blocks returns only as many links as join its components.

Cases: a text without words (or null) is linked with nothing; a text with fewer
words than a shingle has its whole sequence as one; rows that share a doc_id are
nodes of their own when their texts differ; null doc_ids are no smallest id;
repeated rows have one class; an empty table gives an empty result; further
columns are left out of the report and kept by :func:`keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_totals, packed, released, unpacked
from .graph import components

SKETCH = 48
MISS = 1e-9
BLOCK = 128
#: Members whose full sets meet their hub's in one group, about.
HUB_MEMBERS = 256
#: Columns of the shared-value count that a block holds at once.
CHUNK = 8192

#: Hashes of words that a task keeps at once.
WORDS_KEPT = 200_000

_ROW = "doc_id long, digest long, n_shingles long, node binary, sketch array<long>"


@lru_cache
def overlap_floor(k: int, percent: int, miss: float = MISS) -> int:
    """The most shared values that k draws with the given probability reach but for a chance of ``miss``."""
    t, tail = percent / 100, 0.0
    for x in range(k + 1):
        tail += math.comb(k, x) * t**x * (1 - t) ** (k - x)
        if tail > miss:
            return x
    return k


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct 63-bit hashes of the word shingles of a text."""

    def __init__(self, width: int) -> None:
        self.width, self.words = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, dtype=np.int64)
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        known = self.words
        hashes = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh3_64_intdigest(w)
            hashes[i] = h
        n = len(words) - self.width + 1
        with np.errstate(over="ignore"):
            if n < 1:
                h = np.full(1, len(words), dtype=np.uint64)
                for x in hashes:
                    h = _mix(h * np.uint64(31) + x)
            else:
                h = np.full(n, self.width, dtype=np.uint64)
                for i in range(self.width):
                    h = _mix(h * np.uint64(31) + hashes[i : i + n])
        return np.unique((h >> np.uint64(1)).astype(np.int64))


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            nodes, counts, sketches = [], [], []
            ids = batch.column("doc_id").to_pylist()
            for doc, text in zip(ids, batch.column("text"), strict=True):
                found = shingles(text.as_py())
                data = found.tobytes() if len(found) else f"none {doc}".encode()
                nodes.append(xxhash.xxh3_128_digest(data))
                counts.append(len(found))
                sketches.append(found[:k])
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "digest": batch.column("digest"),
                    "n_shingles": pa.array(counts, pa.int64()),
                    "node": pa.array(nodes, pa.binary()),
                    "sketch": pa.array(sketches, pa.list_(pa.int64())),
                }
            )

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": part.column("node"),
                        "shingles": pa.array([shingles(t.as_py()) for t in part.column("text")], pa.list_(pa.int64())),
                    }
                )

    return run


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _inverted_lists(classes: DataFrame, k: int, floor: int, percent: int) -> DataFrame:
    """(value, node, n, score): the lists with two members or more, one of those with the same members."""
    values = classes.select("node", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    shared = _anew(values.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "value")
    needed = F.least(F.lit(floor), F.ceil(F.col("n") * percent / 100))
    by_node = (
        values.join(shared, "value")
        .groupBy("node", "n", "size")
        .agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))
        .withColumn("take", F.col("size") - needed + 1 - (F.col("size") - F.size("found")))
        .filter("take > 0")
    )
    lists = checkpointed(
        by_node.select(
            "node",
            "n",
            F.aggregate("found", F.lit(0).cast("long"), lambda t, x: t + x["df"]).alias("score"),
            F.explode(F.slice("found", F.lit(1), F.col("take").cast("int"))).alias("x"),
        ).select("node", "n", "score", F.col("x.value").alias("value"))
    )
    part = F.shiftright(F.xxhash64("node"), 20)
    members = (
        lists.groupBy("value")
        .agg(F.count(F.lit(1)).alias("m"), F.sum(part).alias("s1"), F.sum(F.shiftright(F.xxhash64("node", "n"), 20)).alias("s2"))
        .filter("m > 1")
    )
    chosen = members.groupBy("m", "s1", "s2").agg(F.min("value").alias("value")).select("value")
    return lists.join(_anew(chosen, "value"), "value")


def _anew(rows: DataFrame, column: str) -> DataFrame:
    """The rows of a small table, written, with a column that is known to be equal but not to be how they are dealt.

    A join with the table then shuffles both sides, and Spark can split a value that very many rows of the
    other side have, which it doesn't where one side comes from an aggregate by the same column.
    """
    return checkpointed(rows).withColumn(column, F.coalesce(F.col(column), F.col(column)))


def _likely_pairs(pairs: DataFrame, sketches: DataFrame, k: int, floor: int, percent: int) -> DataFrame:
    """The pairs (hub, node) that by the estimate on their sketches may be linked."""
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    union = F.array_sort(F.array_union("sketch_hub", "sketch_node"))
    whole = (F.size("sketch_hub") < k) & (F.size("sketch_node") < k)
    union = F.when(whole, union).otherwise(F.slice(union, 1, k))
    both = F.size(F.array_intersect(F.array_intersect("sketch_hub", "sketch_node"), F.col("union")))
    least = F.when(whole, F.ceil(F.size("union") * percent / 100)).otherwise(F.least(F.lit(floor), F.size("union")))
    return pairs.join(side("hub"), "hub").join(side("node"), "node").withColumn("union", union).filter(both >= least).select("hub", "node")


def _hub_links(percent: int):
    """The members whose full sets are as similar to their hub's as asked; the hub's set is there once."""

    def run(key: tuple[pa.Scalar, ...], members: pa.Table) -> pa.Table:
        hub = key[0].as_py()
        nodes, sets = members.column("node").to_pylist(), members.column("shingles")
        own = sets[nodes.index(hub)].values.to_numpy()
        linked = []
        for n, node in enumerate(nodes):
            if node != hub:
                other = sets[n].values.to_numpy()
                place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                common = int((own[place] == other).sum())
                if 100 * common >= percent * (len(own) + len(other) - common):
                    linked.append(node)
        return pa.table({"a": pa.array([hub] * len(linked), pa.binary()), "b": pa.array(linked, pa.binary())})

    return run


def _verified(pairs: DataFrame, sketches: DataFrame, sets: DataFrame, k: int, floor: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are as similar as asked, after the estimate on their sketches.

    Members meet their hub in parts of about HUB_MEMBERS, so a set is sent once for each hub that a member
    may be linked with, and a hub's set once for each part.
    """
    likely = checkpointed(_likely_pairs(pairs, sketches, k, floor, percent))
    counts = checkpointed(likely.groupBy("hub").agg(F.count(F.lit(1)).alias("m")))
    salts = F.ceil(F.col("m") / HUB_MEMBERS).cast("int").alias("salts")
    dealt = join_totals(likely, counts.select("hub", "m", salts), "hub", "m", likely.count())
    members = dealt.select("hub", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), "node")
    hubs = counts.select("hub", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.col("hub").alias("node"))
    return members.unionByName(hubs).join(sets, "node").groupBy("hub", "salt").applyInArrow(_hub_links(percent), "a binary, b binary")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set on the left has in common with each on the right."""
    values = np.unique(np.concatenate([*left, *right]))
    shared = np.zeros((len(left), len(right)), dtype=np.float64)
    places = [[np.searchsorted(values, s) for s in side] for side in (left, right)]
    for at in range(0, len(values), CHUNK):
        marks = []
        for side in places:
            part = np.zeros((len(side), min(CHUNK, len(values) - at)), dtype=np.float32)
            for n, place in enumerate(side):
                low, high = np.searchsorted(place, (at, at + CHUNK))
                part[n, place[low:high] - at] = 1
            marks.append(part)
        shared += marks[0] @ marks[1].T
    return shared


def _sides(key: tuple[pa.Scalar, ...], members: pa.Table, column: str) -> tuple[list[pa.Table], list[list[np.ndarray]]]:
    """The members on both sides of a pair of blocks and their arrays; both sides are the same where a block meets itself."""
    sides = [members.filter(pc.equal(members.column("side"), side)) for side in (0, 1)]
    if key[1] == key[2]:
        sides[1] = sides[0]
    return sides, [[x.values.to_numpy() for x in side.column(column)] for side in sides]


def _likely(a: np.ndarray, b: np.ndarray, k: int, floor: int, percent: int) -> bool:
    """The union-sketch estimate: whether two sketches have as many values of their union's sketch in common as a link would."""
    union = np.union1d(a, b)
    whole = len(a) < k and len(b) < k
    both = np.intersect1d(a, b, assume_unique=True)
    if whole:
        return 100 * len(both) >= percent * len(union)
    union = union[:k]
    return int((both <= union[-1]).sum()) >= min(floor, len(union))


def _block_candidates(k: int, floor: int, percent: int):
    """(hub, i, j, side, node, root): members that by the estimate may be linked with one of another component in the other block."""

    def run(key: tuple[pa.Scalar, ...], members: pa.Table) -> pa.Table:
        sides, sketches = _sides(key, members, "sketch")
        wanted: list[set[int]] = [set(), set()]
        if sides[0].num_rows and sides[1].num_rows:
            shared = _shared(*sketches)
            lengths = [np.array([len(x) for x in side]) for side in sketches]
            names = [side.column("root").to_pylist() for side in sides]
            ids = {r: n for n, r in enumerate(dict.fromkeys(names[0] + names[1]))}
            roots = [np.array([ids[r] for r in side]) for side in names]
            # Shared values are at least those shared within the union's sketch.
            small = np.minimum(lengths[0][:, None], lengths[1][None, :])
            least = np.where(small < k, np.minimum(floor, np.ceil(small * percent / 100)), floor)
            for i, j in zip(*np.nonzero((shared >= least) & (roots[0][:, None] != roots[1][None, :])), strict=True):
                if (i not in wanted[0] or j not in wanted[1]) and _likely(sketches[0][i], sketches[1][j], k, floor, percent):
                    wanted[0].add(i)
                    wanted[1].add(j)
        parts = [side.take(pa.array(sorted(want), pa.int64())) for side, want in zip(sides, wanted, strict=True)]
        sizes = [p.num_rows for p in parts]
        both = pa.concat_tables([p.select(["node", "root"]) for p in parts])
        n = both.num_rows
        return pa.table(
            {
                "hub": pa.array([key[0].as_py()] * n, pa.binary()),
                "i": pa.array([key[1].as_py()] * n, pa.int32()),
                "j": pa.array([key[2].as_py()] * n, pa.int32()),
                "side": pa.array([0] * sizes[0] + [1] * sizes[1], pa.int32()),
                "node": both.column("node"),
                "root": both.column("root"),
            }
        )

    return run


def _block_links(percent: int):
    def run(key: tuple[pa.Scalar, ...], members: pa.Table) -> pa.Table:
        sides, sets = _sides((key[0], pa.scalar(0), pa.scalar(1)), members, "shingles")
        pairs: list[tuple[bytes, bytes]] = []
        if sides[0].num_rows and sides[1].num_rows:
            n_a, n_b = (np.array([len(x) for x in side], dtype=np.float64) for side in sets)
            shared = _shared(*sets)
            linked = 100 * shared >= percent * (n_a[:, None] + n_b[None, :] - shared)
            nodes, roots = ([side.column(c).to_pylist() for side in sides] for c in ("node", "root"))
            parent: dict[bytes, bytes] = {}

            def top(x: bytes) -> bytes:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            for i, j in zip(*np.nonzero(linked), strict=True):
                a, b = top(roots[0][i]), top(roots[1][j])
                if a != b:
                    parent[a] = b
                    pairs.append((nodes[0][i], nodes[1][j]))
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.binary()), "b": pa.array([p[1] for p in pairs], pa.binary())})

    return run


def _dealt(stars: DataFrame, roots: DataFrame, sketches: DataFrame) -> DataFrame:
    """The sketches of members of centres with several components, dealt to pairs of blocks (hub, i, j).

    Members of the largest component meet the blocks of the others only.
    """
    rooted = checkpointed(stars.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    parts = rooted.groupBy("hub", "root").agg(F.count(F.lit(1)).alias("size"))
    giants = (
        parts.groupBy("hub")
        .agg(F.max(F.struct("size", "root")).alias("giant"), F.sum("size").alias("all"))
        .filter("all > giant.size")
        .select(
            "hub",
            F.col("giant.root").alias("giant"),
            F.ceil(F.col("giant.size") / BLOCK).cast("int").alias("giant_blocks"),
            F.ceil((F.col("all") - F.col("giant.size")) / BLOCK).cast("int").alias("blocks"),
        )
    )
    split = rooted.join(_anew(giants, "hub"), "hub").join(sketches, "node")
    inside = F.col("root") == F.col("giant")
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.when(inside, F.col("giant_blocks")).otherwise(F.col("blocks"))).cast("int")
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), side.alias("side"))
    small = F.sequence(F.lit(0), F.col("blocks") - 1)
    for_giant = F.transform(small, lambda i: pair(i, F.col("blocks") + F.col("block"), F.lit(1)))
    with_giant = F.transform(
        F.sequence(F.lit(0), F.col("giant_blocks") - 1), lambda j: pair(F.col("block"), F.col("blocks") + j, F.lit(0))
    )
    with_small = F.transform(
        small, lambda o: pair(F.least("block", o), F.greatest("block", o), (F.col("block") > o).cast("int"))
    )
    split = split.withColumn("block", block)
    places = F.when(inside, for_giant).otherwise(F.concat(with_giant, with_small))
    return split.select("hub", "node", "root", "sketch", F.inline(places))


def link_classes(docs: DataFrame, width: int, percent: int, k: int = SKETCH) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows are (doc_id, digest, n_shingles, node); groups (node, root, component_id)."""
    floor = overlap_floor(k, percent)
    texts = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string"), _digest(F.col("text")).alias("digest")
    )
    rows = checkpointed(texts.mapInArrow(_sketches(width, k), _ROW))
    classes = rows.groupBy("node").agg(
        F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest"))).alias("first"),
        F.first("n_shingles").alias("n"),
        F.first("sketch").alias("sketch"),
    )
    classes = checkpointed(
        classes.select("node", F.col("first.doc_id").alias("rep"), F.col("first.digest").alias("digest"), "n", "sketch")
    )
    lists = checkpointed(_inverted_lists(classes.filter("n > 0"), k, floor, percent))
    members = lists.select("node").distinct()
    chosen = checkpointed(classes.join(members, "node"))
    roots = None
    if chosen.count():
        same = F.col("t.doc_id").eqNullSafe(F.col("c.rep")) & (F.col("t.digest") == F.col("c.digest"))
        wanted = (
            texts.alias("t")
            .join(chosen.select("node", "rep", "digest").alias("c"), same)
            .select("node", "text")
        )
        released(docs.sparkSession)
        sets = checkpointed(wanted.mapInArrow(_full_sets(width), "node binary, shingles array<long>").dropDuplicates(["node"]))
        roots = _components_of(lists, chosen.select("node", "sketch"), sets, k, floor, percent)
    found = classes.select("node", "rep")
    if roots is None:
        return rows, found.select("node", F.col("node").alias("root"), F.col("rep").alias("component_id"))
    grouped = checkpointed(found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    smallest = grouped.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("_n"))
    released(docs.sparkSession)
    return rows, join_totals(grouped.select("node", "root"), smallest, "root", "_n", grouped.count())


def _components_of(lists: DataFrame, sketches: DataFrame, sets: DataFrame, k: int, floor: int, percent: int) -> DataFrame:
    centre = F.max_by(F.struct("node", "n"), F.struct("score", "node")).alias("centre")
    stars = checkpointed(
        lists.join(_anew(lists.groupBy("value").agg(centre), "value"), "value")
        .select(F.col("centre.node").alias("hub"), F.col("centre.n").alias("hub_n"), "node", "n")
        .distinct()
    )
    pairs = (
        stars.filter(F.col("hub") != F.col("node"))
        .filter(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
        .groupBy(F.least("node", "hub"), F.greatest("node", "hub"))
        .agg(F.max_by(F.struct("hub", "node"), "hub").alias("pair"))
        .select("pair.*")
    )
    links = checkpointed(_verified(pairs, sketches, sets, k, floor, percent))
    roots = checkpointed(components(links))
    released(lists.sparkSession)
    wanted = checkpointed(
        _dealt(stars, roots, sketches)
        .groupBy("hub", "i", "j")
        .applyInArrow(_block_candidates(k, floor, percent), "hub binary, i int, j int, side int, node binary, root binary")
    )
    more = checkpointed(wanted.join(sets, "node").groupBy("hub", "i", "j").applyInArrow(_block_links(percent), "a binary, b binary"))
    if not more.take(1):
        return roots
    return checkpointed(components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, digest, group) for each document.

    Documents whose sets of ``width``-word shingles have ``percent`` per cent of
    their union in common are linked; ``group`` is the same for all that links connect.
    """
    rows, groups = link_classes(docs, width, percent, k)
    return rows.select("doc_id", "digest", "n_shingles", "node").join(groups, "node").select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "digest",
        F.col("root").alias("group"),
    )


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group, that with the smallest doc_id, with all its columns."""
    found = near_duplicates(docs, width, percent).filter("kept")
    identity = lambda doc: {"_null": doc.isNull(), "_id": F.coalesce(doc, F.lit(0).cast("long"))}
    winners = found.groupBy("group", "doc_id").agg(F.min("digest").alias("_mark")).withColumns(identity(F.col("doc_id")))
    winners = checkpointed(winners.select("_null", "_id", "_mark").distinct())
    released(docs.sparkSession)
    keyed = packed(docs, **identity(F.col("doc_id").cast("long")), _mark=_digest(F.col("text")))
    # Repeated rows meet within each task first; the join needs no further shuffle of the rows.
    once = keyed.dropDuplicates(["_null", "_id", "_mark"])
    return unpacked(once.join(winners, ["_null", "_id", "_mark"], "left_semi"), docs.columns)


def near_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): three-word shingles, 85 of 100 in common."""
    return near_duplicates(docs, 3, 85).select("doc_id", "n_shingles", "component_id", "kept")
