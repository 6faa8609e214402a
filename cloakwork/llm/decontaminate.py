"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts and benchmark items are normalised to lower-case words with single spaces.
An item of m characters may be changed by e = m / 12 edits.  By the q-gram lemma an
occurrence with at most e edits shares at least m - q + 1 - q * e of the item's
q-grams, all on diagonals no more than e apart, so shared q-grams are counted in
diagonal bands of e + 1, two neighbours at a time, and only bands that reach the
bound are retained.  A banded alignment of the whole item against the region of
the band verifies it.

A quoted part of an item counts as well: an item of more than ``WINDOW_WORDS`` words
is also cut into windows of so many at every half window, and each window is looked for
in the same way.  So a run of one and a half windows' words of a longer item is always
found; of shorter items, and of those without spaces, only the whole is.  Where the whole
item is found, its windows aren't listed.

Grams are of code points: each is folded to a byte, those of Latin-1 to themselves, and eight make a number, so that
different grams may share a number, which the alignment, on the code points, sorts out.
A gram with more than ``PLACES`` places in the benchmark isn't counted, and the bound of each item is lower by its number of
such grams; an item that would keep less than half of its bound counts all of its grams.  Counting goes in parts of ``PART`` places.

A document is scanned in one pass with numpy: its grams are sorted out by a
bit table before they are looked up.  Documents are never shuffled.
The benchmark's grams are sent to the executors in blocks of at most
``BLOCK_BYTES`` of text, windows included.  With a larger benchmark one pass over the documents, with a table of all
its grams, keeps those that share enough grams with it, and the passes for each block go over these.

An item whose normal form is under ``LEAST_BYTES`` bytes of UTF-8 (four or five words of a Latin alphabet, eight ideographs)
isn't looked for, as such phrases stand in clean text; :func:`items_left_out` lists them.

Cases: null and empty texts and items match nothing; repeated rows of documents give one match in the report,
and items with equal item_id and text count once; an empty table gives no
matches; texts are scanned whole; further columns are kept by :func:`drop_contaminated`, which judges each row by its own
text, whatever other rows share its doc_id or have none.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, packed, unpacked

Q = 8
EDIT_SHARE = 12
WINDOW_WORDS = 24
#: Bytes of benchmark text that are sent to the executors at once.
BLOCK_BYTES = 4 << 20
#: Places of a gram in a block beyond which it isn't counted, and places that are counted at once.
PLACES = 64
#: Bytes that an item's normal form must have to be looked for; no fewer than Q characters have them.
LEAST_BYTES = 24
PART = 1 << 22
#: Bits of the table of all grams of a benchmark of several blocks, 16 MB at most.
MAX_TABLE_BITS = 27
#: Contaminated rows, 16 bytes each, up to which they are sent to all executors; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000
_NO_WORD = re.compile(r"\W+")
_WORD = re.compile(r"\w+")
_FAR = 1 << 40
_PLACES_SQL = "doc_id long, digest long, item_id long, start long, end long, edits long"


def normalise(text: str | None) -> str:
    return _NO_WORD.sub(" ", (text or "").lower()).strip()


def is_long_enough(item: str) -> bool:
    return len(item) >= Q and len(item.encode()) >= LEAST_BYTES


def windows(item: str) -> list[str]:
    """Overlapping windows of a normalised item that is longer than a window; the last ends with the item."""
    words = item.split(" ")
    last = len(words) - WINDOW_WORDS
    if last <= 0:
        return []
    return [" ".join(words[at : at + WINDOW_WORDS]) for at in [*range(0, last, WINDOW_WORDS // 2), last]]


def budget(m: int) -> int:
    """Edits that an item of m characters may have; fewer if the lemma's bound would be under a quarter of a gram's characters."""
    edits = m // EDIT_SHARE
    while edits and m - Q + 1 - Q * edits < 2:
        edits -= 1
    return edits


def points(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def grams(text: str) -> np.ndarray:
    """The grams of a text as numbers, one for each place: eight code points, each folded to a byte."""
    if len(text) < Q:
        return np.empty(0, dtype=np.uint64)
    try:
        data = text.encode("latin-1")
    except UnicodeEncodeError:
        codes = points(text).astype(np.uint64)
        folded = ((codes * np.uint64(0x9E3779B1)) >> np.uint64(24)) & np.uint64(0xFF)
        data = np.where(codes < 256, codes, folded).astype(np.uint8).tobytes()
    return np.ndarray(shape=(len(data) - Q + 1,), dtype="<u8", buffer=data, strides=(1,)).astype(np.uint64)


def _slot(codes: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def align(item: str, region: str, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of the item in the region, or None if it takes more edits.

    Row i holds the fewest edits of the item's first i characters ending at each
    place, computed only where diagonals are inside the region's band.
    """
    if (at := region.find(item)) >= 0:
        return 0, at, at + len(item)
    m, n = len(item), len(region)
    width = n - m + 2 * edits + 1  # diagonals from -edits to n - m + edits
    if width <= 0:
        return None
    text, wanted = points(region), points(item)
    far = edits + 1
    # cost[d]: diagonal d - edits, that is column i + d - edits in row i.
    cols = np.arange(width) - edits
    cost = np.where((cols >= 0) & (cols <= n), 0, far).astype(np.int64)
    start = cols.copy()
    steps = np.arange(width)
    for i in range(1, m + 1):
        at = cols + i
        inside = (at >= 1) & (at <= n)
        same = np.zeros(width, dtype=bool)
        same[inside] = text[at[inside] - 1] == wanted[i - 1]
        change = np.where(inside, cost + ~same, far)
        origin = start
        delete = np.append(cost[1:], far) + 1  # the item's character has no partner
        better = delete < change
        change = np.where(better, delete, change)
        origin = np.where(better, np.append(start[1:], 0), origin)
        change[(at < 0) | (at > n)] = far
        # Characters of the region without a partner: each costs one along the row.
        base = change - steps
        lowest = np.minimum.accumulate(base)
        fresh = np.concatenate([[True], base[1:] < lowest[:-1]])
        start = origin[np.maximum.accumulate(np.where(fresh, steps, 0))]
        cost = np.minimum(lowest + steps, far)
        if cost.min() > edits:
            return None
    cost = np.where((cols + m >= 0) & (cols + m <= n), cost, far)
    best = int(np.argmin(cost))
    if cost[best] > edits:
        return None
    return int(cost[best]), int(start[best]), int(cols[best] + m)


class Index:
    """The grams of a block of items and then of their windows, with the items and places that have them."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = [(i, t) for i, t in items if is_long_enough(t)]
        self.whole = len(self.items)
        self.items += [(i, w) for i, t in self.items for w in windows(t) if len(w) >= Q]
        parts = [grams(t) for _, t in self.items]
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        codes = np.concatenate([*parts, np.empty(0, dtype=np.uint64)])
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        item = np.repeat(np.arange(len(parts), dtype=np.int32), lengths)[order]
        place = np.concatenate([*(np.arange(n, dtype=np.int32) for n in lengths), np.empty(0, dtype=np.int32)])[order]
        self.edits = np.array([budget(len(t)) for _, t in self.items], dtype=np.int64)
        self.needed = lengths - Q * self.edits
        _, group, counts = np.unique(codes, return_inverse=True, return_counts=True)
        common = counts[group] > PLACES
        lost = np.bincount(item[common], minlength=len(parts))
        lowered = self.needed - lost
        all_grams = 2 * lowered < self.needed
        self.needed = np.where(all_grams, self.needed, lowered)
        stay = ~common | all_grams[item]
        self.item, self.place = item[stay], place[stay]
        self.codes, self.first, self.counts = np.unique(codes[stay], return_index=True, return_counts=True)
        self.least = int(self.needed.min()) if len(parts) else 0
        self.bits = max(16, (8 * len(self.codes)).bit_length())
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[_slot(self.codes, self.bits)] = True

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, start, end, edits) in the normalised text; of places that overlap a whole item or else the best window."""
        found = []
        for item, low, high in self._bands(text):  # whole items come first
            name, data = self.items[item]
            part, middle = item >= self.whole, (low + high) // 2
            if part and any(f[0] == name and not f[4] and f[1] <= middle < f[2] for f in found):
                continue
            if hit := align(data, text[low:high], int(self.edits[item])):
                found.append((name, low + hit[1], low + hit[2], hit[0], part))
        best: list[tuple[int, int, int, int]] = []
        for name, start, end, edits, _ in sorted(found, key=lambda f: (f[0], f[4], f[3], f[1], f[2])):
            if all(name != o[0] or end <= o[1] or start >= o[2] for o in best):
                best.append((name, start, end, edits))
        return best

    def _bands(self, text: str) -> list[tuple[int, int, int]]:
        """(item, low, high): regions of the text that share enough grams with an item."""
        codes = grams(text)
        if not len(self.codes) or not len(codes):
            return []
        at = np.flatnonzero(self.table[_slot(codes, self.bits)])
        if len(at) < self.least:
            return []
        where = np.minimum(np.searchsorted(self.codes, codes[at]), len(self.codes) - 1)
        real = self.codes[where] == codes[at]
        at, where = at[real], where[real]
        if len(at) < self.least or not len(at):
            return []
        keys, shared = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        ends = np.cumsum(self.counts[where])
        low = 0
        while low < len(at):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PART, side="right")))
            found, number = np.unique(self._keys(at[low:high], where[low:high]), return_counts=True)
            keys, back = np.unique(np.concatenate([keys, found]), return_inverse=True)
            shared = np.bincount(back, weights=np.concatenate([shared, number])).astype(np.int64)
            low = high
        pair = np.zeros(len(keys), dtype=np.int64)
        beside = np.flatnonzero(np.diff(keys) == 1)
        pair[beside] = shared[beside + 1]
        item, band = keys // _FAR, keys % _FAR
        # A band counts with the next one; one that has no neighbour below counts alone as well.
        enough = np.flatnonzero(shared + pair >= self.needed[item])
        # Neighbours that are all retained, as in text that repeats itself, are one region.
        regions, k = [], 0
        while k < len(enough):
            first = enough[k]
            while k + 1 < len(enough) and item[enough[k + 1]] == item[first] and band[enough[k + 1]] == band[enough[k]] + 1:
                k += 1
            i, e = int(item[first]), int(self.edits[item[first]])
            low, high = (int(band[x]) * (e + 1) - _FAR // 2 for x in (first, enough[k]))
            regions.append((i, max(0, low - e), min(len(text), high + 2 * (e + 1) + len(self.items[i][1]) + e)))
            k += 1
        return regions

    def _keys(self, at: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Item and diagonal band, as one number, of every place in the items that has a gram of the text."""
        counts = self.counts[where]
        ends = np.cumsum(counts)
        entry = np.arange(ends[-1]) - np.repeat(ends - counts, counts) + np.repeat(self.first[where], counts)
        item = self.item[entry].astype(np.int64)
        return item * _FAR + (np.repeat(at, counts) - self.place[entry] + _FAR // 2) // (self.edits[item] + 1)


def _original(text: str, start: int, end: int) -> tuple[int, int]:
    """Code points of the text that characters start to end of its normal form come from, in whole words."""
    lower = text.lower()
    at, first, last = 0, None, 0
    for m in _WORD.finditer(lower):
        size = m.end() - m.start()
        if first is None and at + size > start:
            first = m.start()
        if at < end:
            last = m.end()
        at += size + 1
    if len(lower) == len(text):
        return first or 0, last
    ends = list(accumulate(len(c.lower()) for c in text))  # a letter whose lower case has a mark of its own is two there
    return bisect_right(ends, first or 0), bisect_left(ends, last) + 1 if last else 0


def _scan(block):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(block.value)
        for batch in batches:
            rows, items, starts, ends, edits = [], [], [], [], []
            for row, value in enumerate(batch.column("text")):
                text = value.as_py()
                for item, start, end, cost in index.find(normalise(text)):
                    first, last = _original(text, start, end)
                    rows.append(row)
                    items.append(item)
                    starts.append(first)
                    ends.append(last)
                    edits.append(cost)
            taken = pa.array(rows, pa.int64())
            columns = [batch.column("doc_id").take(taken), batch.column("digest").take(taken)]
            columns += [pa.array(x, pa.int64()) for x in (items, starts, ends, edits)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "item_id", "start", "end", "edits"])

    return run


def _sift(shipped):
    """Rows whose texts share as many grams with a benchmark as any match must."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed_table, bits, least = shipped.value
        table = np.unpackbits(np.frombuffer(packed_table, dtype=np.uint8)).view(bool)

        def keeps(value: str | None) -> bool:
            text = normalise(value)
            return least is not None and len(text) >= Q and int(table[_slot(grams(text), bits)].sum()) >= max(1, least)

        for batch in batches:
            kept = [n for n, t in enumerate(batch.column("text")) if keeps(t.as_py())]
            yield batch.take(pa.array(kept, pa.int64()))

    return run


def _find(texts: DataFrame, benchmark: DataFrame, block_bytes: int) -> DataFrame:
    """The places of items in (doc_id, digest, text)."""
    spark = texts.sparkSession
    items = checkpointed(
        benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null").distinct()
    )
    # Windows have twice the bytes of an item, and a last one.
    cut = F.when(F.size(F.split("text", r"\W+")) > WINDOW_WORDS, 4).otherwise(1)
    total = items.agg(F.sum(F.octet_length("text") * cut)).first()[0] or 0
    number = -(-total // block_bytes)

    def block(n: int) -> list[tuple[int, str]]:
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(number)) == n) if number > 1 else items
        return [(r.item_id, normalise(r.text)) for r in part.collect()]

    if number > 1:
        bits = min(MAX_TABLE_BITS, max(16, (8 * total).bit_length()))
        table, least = np.zeros(1 << bits, dtype=bool), None
        for n in range(number):
            index = Index(block(n))
            table[_slot(index.codes, bits)] = True
            if index.items:
                least = index.least if least is None else min(least, index.least)
        shipped = spark.sparkContext.broadcast((np.packbits(table).tobytes(), bits, least))
        texts = checkpointed(texts.mapInArrow(_sift(shipped), texts.schema))
    found = [texts.mapInArrow(_scan(spark.sparkContext.broadcast(block(n))), _PLACES_SQL) for n in range(number)]
    if number > 1:
        found = [checkpointed(f) for f in found]
    return reduce(DataFrame.unionByName, found, spark.createDataFrame([], _PLACES_SQL) if not found else found.pop())


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"), text.alias("text"))


def find_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, start, end, edits): every place of a benchmark item or of a window of it in a document, in code points."""
    return _find(_texts(docs), benchmark, block_bytes).drop("digest")


def items_left_out(benchmark: DataFrame) -> DataFrame:
    """The rows of the benchmark that are too short to be looked for, nulls included."""
    short = F.udf(lambda text: not is_long_enough(normalise(text)), "boolean", useArrow=True)
    return benchmark.filter(short(F.col("text").cast("string")))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, places, start, end, edits) for each document that holds a benchmark item; the best place."""
    best = F.min(F.struct("edits", "start", "end")).alias("best")
    return (
        find_contaminated(docs, benchmark)
        .distinct()
        .groupBy("doc_id", "item_id")
        .agg(F.count(F.lit(1)).alias("places"), best)
        .select("doc_id", "item_id", "places", "best.start", "best.end", "best.edits")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows whose text holds no benchmark item, with all their columns."""
    found = _find(_texts(docs), benchmark, block_bytes).select(F.col("doc_id").alias("_doc"), F.col("digest").alias("_digest"))
    found = checkpointed(found.distinct())
    if found.count() <= MAX_BROADCAST_ROWS:
        found = F.broadcast(found)
    keyed = packed(docs, _id=F.col("doc_id").cast("long"), _mark=F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_mark") == F.col("_digest"))
    return unpacked(keyed.join(found, same, "left_anti"), docs.columns)
