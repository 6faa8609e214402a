"""Alignment of two tokenizers' tokens by the bytes that they cover.

The tokens of B tile a text's bytes and make a static interval index: their starts
and ends, sorted.  Each token of A stabs it with two bisections and lists the tokens
of B that it overlaps; these are the links.  A gap between tokens that no token of
either side spans ends a group.

How often two ids are linked in the whole corpus is counted without ever shuffling a row a document and pair.
A task gathers documents into blocks of about two million links and writes, beside its documents,
a row for each pair of ids that the block holds.  Those rows are summed by pair, and the sums go back to the
blocks; the best of each id of B is sent to all, as it has at most a row for each entry of B's vocabulary.
A block holds a pair once, so no pair can have more rows than there are blocks.

Cases: a text that is null or empty, or that either tokenizer doesn't give back byte for
byte (as one with U+2581, which B writes for a space), has no tokens, zeros, and ''; strings of special
tokens are plain text; repeated rows are counted as often as they stand there; texts are aligned whole,
however long, and a long one is a block of its own; an empty table gives an empty
result; a null doc_id stays null; further columns are left out of the report and kept by :func:`align`,
whose ``groups`` takes the place of a column of that name.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import packed, shared_folder, stored, unpacked

#: Links after which a block ends.
BLOCK_LINKS = 2_000_000
#: Largest file of a vocabulary that is sent to all executors.
MAX_FILE = 64 << 20
#: Texts tokenized together.
TEXTS = 200
_SPACE = "▁"


def default_files() -> tuple[str, str]:
    """The places of the public vocabularies of A (byte-level) and B (pieces)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printed, or else the next from U+0100."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printed]
    return {chr(b): b for b in printed} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class Tokenizer(NamedTuple):
    """What alignment needs of a tokenizer: ids of a text, and the bytes of each id."""

    ids: Callable[[str], np.ndarray]
    bytes_of: list[bytes]


def byte_level(data: bytes) -> Tokenizer:
    """The byte-level BPE in a tokenizer's JSON, to which a space and then the text are given."""
    model = json.loads(data)["model"]
    letters = byte_letters()
    special = {t["content"] for t in json.loads(data).get("added_tokens", []) if t.get("special")}
    ranks = {bytes(letters[c] for c in entry): n for entry, n in model["vocab"].items() if entry not in special}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "", 1) for m in model["merges"]]
    order = [model["vocab"][m] for m in merged]
    if order != sorted(order):
        raise ValueError("ids don't follow the order of merges")
    pattern = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for entry, n in ranks.items():
        table[n] = entry
    return Tokenizer(lambda text: encoding.encode_to_numpy(f" {text}", disallowed_special=()).astype(np.int64), table)


def pieces(data: bytes) -> Tokenizer:
    """The piece model, which puts a space before the text itself."""
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    table = [
        bytes([int(p[3:5], 16)]) if model.is_byte(n) else p.replace(_SPACE, " ").encode()
        for n, p in ((n, model.id_to_piece(n)) for n in range(model.get_piece_size()))
    ]
    return Tokenizer(lambda text: np.array(model.encode(text), np.int64), table)


class IntervalIndex:
    """Intervals that tile a range, sorted; a stab gives the run of those that an interval overlaps."""

    def __init__(self, ends: np.ndarray):
        self.ends, self.starts = ends, np.concatenate([[0], ends[:-1]])

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval the first overlapped one, and the one after the last."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left")


class Aligned(NamedTuple):
    """Ids of a text's tokens, the group of each, the byte at which each group ends, and its links as places of tokens."""

    a: np.ndarray
    b: np.ndarray
    group_a: np.ndarray
    group_b: np.ndarray
    group_ends: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


_NONE = np.empty(0, np.int64)
EMPTY = Aligned(*[_NONE] * 7)


class Aligner:
    """Aligns texts, one at a time."""

    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.a, self.b = a, b
        self.sizes = [np.array([len(x) for x in t.bytes_of], np.int64) for t in (a, b)]
        self.names = [[np.array([f"{n}{mark}" for n in range(len(t.bytes_of))], object) for mark in marks] for t, marks in ((a, ",|"), (b, ",;"))]

    def __call__(self, text: str | None) -> Aligned:
        if not text:
            return EMPTY
        a, b = self.a.ids(text), self.b.ids(text)
        whole = b" " + text.encode()
        if any(b"".join(map(t.bytes_of.__getitem__, ids.tolist())) != whole for t, ids in ((self.a, a), (self.b, b))):
            return EMPTY
        ends = np.cumsum(self.sizes[0][a])
        first, last = IntervalIndex(np.cumsum(self.sizes[1][b])).stab(ends - self.sizes[0][a], ends)
        counts = last - first
        link_a = np.repeat(np.arange(len(a)), counts)
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(first, counts)
        # a token of B that overlaps two neighbours in A spans the gap between them
        cut = np.concatenate([last[:-1] <= first[1:], [True]])
        group_a = np.cumsum(cut) - cut
        group_b = np.empty(len(b), np.int64)
        group_b[link_b] = group_a[link_a]
        return Aligned(a, b, group_a, group_b, ends[cut], link_a, link_b)

    def groups_text(self, x: Aligned) -> str:
        """Ids of A and B by group: ``a1,a2|b1;a3|b2,b3``."""
        order = np.argsort(np.concatenate([x.group_a * 2, x.group_b * 2 + 1]), kind="stable")
        ends = [np.append(g[1:] != g[:-1], True) if len(g) else g for g in (x.group_a, x.group_b)]
        words = [np.where(end, last[ids], inner[ids]) for ids, end, (inner, last) in zip((x.a, x.b), ends, self.names)]
        return "".join(np.concatenate(words)[order].tolist())[:-1]


def _pairs(x: Aligned) -> np.ndarray:
    """A number for the pair of ids of each link."""
    return x.a[x.link_a] << 32 | x.b[x.link_b]


def _squeezed(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte plane by byte plane, compressed."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _numbers(data: bytes) -> np.ndarray:
    plain = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(plain.T).view("<u4").reshape(-1).astype(np.int64)


def _shipped(docs: DataFrame, files: tuple[str, str] | None):
    """The files of A and B, read on the driver, as a broadcast variable."""
    data = []
    for name in files or default_files():
        with open(name, "rb") as file:
            data.append(file.read(MAX_FILE + 1))
        if len(data[-1]) > MAX_FILE:
            raise ValueError("a vocabulary of over 64 MB isn't sent to all executors")
    return docs.sparkSession.sparkContext.broadcast(tuple(data))


def _aligner(shipped) -> Aligner:
    a, b = shipped.value
    return Aligner(byte_level(a), pieces(b))


def align(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """All rows of docs with ``groups``, an array of (start, end, a, b): bytes of space and text, and the ids of A and B there."""
    shipped = _shipped(docs, files)
    ids = pa.list_(pa.int32())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", ids), ("b", ids)]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shipped)

        def groups(text: str | None) -> list[dict]:
            x = aligner(text)
            bounds = np.arange(1, len(x.group_ends))
            a, b = np.split(x.a, np.searchsorted(x.group_a, bounds)), np.split(x.b, np.searchsorted(x.group_b, bounds))
            starts = [0, *x.group_ends[:-1].tolist()]
            return [{"start": s, "end": e, "a": p, "b": q} for s, e, p, q in zip(starts, x.group_ends.tolist(), a, b)]

        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            found = pa.array([groups(t) for t in batch.column("text").to_pylist()], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, "groups"])

    rows = packed(docs, text=F.col("text").cast("string"))
    schema = T.StructType([*rows.schema.fields, T.StructField("groups", T._parse_datatype_string("array<struct<start:long,end:long,a:array<int>,b:array<int>>>"))])
    return unpacked(rows.mapInArrow(add, schema), docs.columns, groups=F.col("groups"))


_COUNTS = ("n_a", "n_b", "n_groups", "n_links")
_BLOCKS = pa.schema(
    [("block", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("groups_sha256", pa.string())]
    + [("places", pa.binary()), ("times", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())]
)
_BLOCKS_DDL = f"block long, doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, groups_sha256 string, places binary, times binary, pair long, n long"
_REPORT_DDL = f"doc_id long, {', '.join(f'{c} long' for c in _COUNTS)}, n_best long, count_sum long, groups_sha256 string"


def _block(block: int, docs: list[tuple], pairs: list[np.ndarray], times: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A block's documents, each with the places of its pairs among the block's, and then the block's pairs."""
    every, place = np.unique(np.concatenate(pairs), return_inverse=True)
    total = np.bincount(place, np.concatenate(times), len(every)).astype(np.int64)
    edges = np.cumsum([len(p) for p in pairs])[:-1]
    columns = dict(zip(_BLOCKS.names[1:7], map(list, zip(*docs))))
    columns |= {"block": [block] * len(docs), "places": [_squeezed(np.diff(p, prepend=0)) for p in np.split(place, edges)], "times": [_squeezed(t) for t in times]}
    for rows, known in ((len(docs), columns), (len(every), {"block": np.full(len(every), block), "pair": every, "n": total})):
        yield pa.RecordBatch.from_arrays([pa.array(known[f.name], f.type) if f.name in known else pa.nulls(rows, f.type) for f in _BLOCKS], schema=_BLOCKS)


def blocks(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """Rows of documents and rows of pairs, by block: what :func:`pair_counts` and :func:`align_report` read."""
    shipped = _shipped(docs, files)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(shipped)
        block, links, gathered = TaskContext.get().partitionId() << 32, 0, ([], [], [])
        for batch in (whole.slice(at, TEXTS) for whole in batches for at in range(0, whole.num_rows, TEXTS)):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                x = aligner(text)
                pair, times = np.unique(_pairs(x), return_counts=True)
                digest = hashlib.sha256(aligner.groups_text(x).encode()).hexdigest() if len(x.a) else ""
                row = (doc_id, len(x.a), len(x.b), len(x.group_ends), len(x.link_a), digest)
                for kept, new in zip(gathered, (row, pair, times)):
                    kept.append(new)
                links += len(x.link_a)
                if links >= BLOCK_LINKS:
                    yield from _block(block, *gathered)
                    block, links, gathered = block + 1, 0, ([], [], [])
        if gathered[0]:
            yield from _block(block, *gathered)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(gather, _BLOCKS_DDL)


def pair_counts(gathered: DataFrame) -> DataFrame:
    """(pair, total, best) of the ids linked anywhere: the pair is a's id * 2**32 + b's id, best whether no id of A has more links with that b."""
    totals = gathered.filter(F.col("pair").isNotNull()).groupBy("pair").agg(F.sum("n").alias("total"))
    totals = totals.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))  # at most a row for each id of B
    return totals.join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the counts of their links' pairs summed."""
    order = np.argsort(pairs.column("pair").to_numpy())
    total, best = pairs.column("total").to_numpy()[order], pairs.column("best").to_numpy()[order].astype(np.int64)
    sums, bests = [], []
    for places, times in zip(docs.column("places").to_pylist(), docs.column("times").to_pylist()):
        at, n = np.cumsum(_numbers(places)), _numbers(times)
        sums.append(int(n @ total[at]))
        bests.append(int(n @ best[at]))
    out = {c: docs.column(c) for c in ("doc_id", *_COUNTS)}
    out |= {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64()), "groups_sha256": docs.column("groups_sha256")}
    return pa.table(out)


def align_report(docs: DataFrame, files: tuple[str, str] | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document."""
    gathered = stored(blocks(docs, files), f"{shared_folder(docs.sparkSession)}/align-{uuid.uuid4().hex}")
    of_blocks = gathered.filter(F.col("pair").isNotNull()).select(F.col("block").alias("of"), "pair").join(pair_counts(gathered), "pair")
    rows = gathered.filter(F.col("pair").isNull()).drop("pair", "n")
    return rows.groupBy("block").cogroup(of_blocks.groupBy("of")).applyInArrow(_summed, _REPORT_DDL)
