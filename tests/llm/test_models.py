"""Vector codes, the compression classifier and token alignment against brute force, held-out labels and literal cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cloakwork.llm import align, classify, vectors

from .corpus import empty, frame, rows

VECTORS = "vec_id long, embedding array<float>, label int, code string, error string"


def made_vectors(n: int = 700, width: int = 16, seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 0.2) for _ in range(width)] for _ in range(9)]
    out = []
    for i in range(n):
        near = rng.choice(centres)
        out.append((i * 3, [x + rng.gauss(0, 0.05) for x in near], rng.choice([1, 2, None]), "x", "y"))
    out += [(i, list(v), lab, "x", "y") for i, v, lab, *_ in out[40:90]]  # repeated rows
    out += [(9001, None, 1, "x", "y"), (9002, [None] + [0.0] * (width - 1), 1, "x", "y"), (9003, [math.nan] * width, 1, "x", "y"), (9004, [math.inf] + [0.0] * (width - 1), 2, "x", "y")]
    out += [(9005, [0.5] * 12, 1, "x", "y"), (9006, [], 1, "x", "y"), (None, [0.25] * width, None, "x", "y")]
    out += [(9100 + i, [float(i % 2)] * width, 3, "x", "y") for i in range(30)]  # ties
    rng.shuffle(out)
    return out


def brute_codes(data: list[tuple], width: int, entries: int = 256, rounds: int = 4) -> tuple[list[tuple], str]:
    single = [(i, [float(np.float32(x)) for x in v], lab) for i, v, lab, *_ in data if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted(single, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    q = width // 4
    ints = [[[math.floor(1024 * x) for x in v[p * q : p * q + q]] for p in range(4)] for _, v, _ in kept]
    books = [[list(v[p]) for v in ints[:entries]] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), n) for n, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            members = {}
            for v in ints:
                members.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for n, some in members.items():
                books[p][n] = [sum(c) // len(some) for c in zip(*some)]
    found = [[nearest(v[p], books[p]) for p in range(4)] for v in ints]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, lab), e in zip(kept, errors):
        by_label[lab] += e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{n:02x}" for _, n in f), e, by_label[lab]) for (i, _, lab), f, e in zip(kept, found, errors)], digest


def key(row) -> tuple:
    return tuple((v is None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize("n", [20, 300])
def test_codes_equal_brute_force(spark, n):
    data = made_vectors(n)
    want, digest = brute_codes(data, 16)
    got = vectors.code_report(spark.createDataFrame(data, VECTORS).repartition(5)).collect()
    assert sorted([tuple(r)[:4] for r in got], key=key) == sorted(want, key=key)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_codes_of_an_empty_table(spark):
    got = vectors.code_report(spark.createDataFrame([], VECTORS))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0
    assert vectors.code_report(spark.createDataFrame([(1, None, 2, "x", "y")], VECTORS)).count() == 0


def test_codes_equal_their_sql(spark):
    data = made_vectors(300, 64)
    data = [r for r in {r[0]: r for r in data if r[0] is not None and (r[1] is None or len(r[1]) == 64)}.values()]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", [list(r[:3]) for r in data])
    got = vectors.code_report(spark.createDataFrame(data, VECTORS)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(vectors.ORACLE).fetchall())


def test_search_is_exact_for_large_components_and_ties():
    rng = np.random.default_rng(5)
    entries = rng.integers(-(2**23), 2**23, (40, 8))
    entries[7] = entries[3]
    x = np.concatenate([rng.integers(-(2**23), 2**23, (200, 8)), entries])
    found, least = vectors.Codebook(entries).nearest(x, rng.integers(0, 40, len(x)))
    away = [[int(((a.astype(object) - e.astype(object)) ** 2).sum()) for e in entries] for a in x]
    assert found.tolist() == [row.index(min(row)) for row in away] and least.tolist() == [min(row) for row in away]
    with pytest.raises(ValueError):
        vectors.integers(np.array([1e30]))


def brute_alignments(texts: list[str | None]) -> list[tuple]:
    a_file, b_file = align.default_files()
    a_model, b_model = Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
    a_model.encode_special_tokens = True
    letters, entries = align.byte_letters(), {n: e for e, n in a_model.get_vocab().items()}

    def spans(pairs):
        end, out = 0, []
        for n, b in pairs:
            out.append((n, end, end + len(b)))
            end += len(b)
        return out

    made, counts = [], Counter()
    for text in texts:
        a = [(n, bytes(letters[c] for c in entries[n])) for n in a_model.encode(f" {text}", add_special_tokens=False).ids] if text else []
        b = [(n, bytes([int(b_model.id_to_piece(n)[3:5], 16)]) if b_model.is_byte(n) else b_model.id_to_piece(n).replace("▁", " ").encode()) for n in b_model.encode(text or "")]
        if any(b"".join(x for _, x in some) != f" {text}".encode() for some in (a, b)):
            a = b = []
        a, b = spans(a), spans(b)
        links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [[",".join(str(n) for n, s, e in some if lo <= s and e <= hi) for some in (a, b)] for lo, hi in zip([0, *cuts], cuts)]
        counts.update(links)
        made.append((len(a), len(b), len(cuts), links, hashlib.sha256(";".join(map("|".join, groups)).encode()).hexdigest() if a else ""))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    return [(na, nb, ng, len(ls), sum(counts[p] == best[p[1]] for p in ls), sum(counts[p] for p in ls), h) for na, nb, ng, ls, h in made]


ODD = ["x <|endoftext|> y<s></s><unk><0x41>", "a▁b", "\x00 �  é\u0085f \U0001f600 ﬁ½", " leading", "  two ", "\n\r\n\t", "naïve 日本語 text", "a" * 3000, " " * 3000, "don't 'S 's İ٣²", "　 wide"]


def test_alignment_equals_brute_force(spark, monkeypatch):
    data = [(r[0], r[1]) for r in rows(n=60)] + [(1000 + n, t) for n, t in enumerate(ODD)] + [(2000, "word " * 900)]
    want = brute_alignments([t for _, t in data])
    for limit in (align.BLOCK_LINKS, 50):
        monkeypatch.setattr(align, "BLOCK_LINKS", limit)
        docs = spark.createDataFrame([(i, t, "x", 7) for i, t in data], "doc_id long, text string, block string, pair int").repartition(3)
        got = align.align_report(docs).collect()
        assert Counter(map(tuple, got)) == Counter((i, *w) for (i, _), w in zip(data, want))


def test_alignment_groups_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Tokenizers", "x"), (2, None, "y"), (3, "", "z")], "doc_id long, text string, groups string")
    got = {r["doc_id"]: r["groups"] for r in align.align(docs).collect()}
    assert got[2] == got[3] == []
    assert got[1][0]["start"] == 0 and got[1][-1]["end"] == len(" Tokenizers")
    assert all(x["end"] == y["start"] for x, y in zip(got[1], got[1][1:]))
    assert align.align(docs).columns == ["doc_id", "text", "groups"]
    assert align.align_report(empty(spark)).count() == align.align(empty(spark)).count() == 0


def test_the_index_stabs_what_overlaps():
    index = align.IntervalIndex(np.array([2, 3, 7, 9]))
    first, last = index.stab(np.array([0, 2, 6]), np.array([2, 7, 9]))
    assert list(zip(first, last)) == [(0, 1), (1, 3), (2, 4)]


def labelled(n: int = 400, seed: int = 2) -> tuple[list[tuple], list[tuple]]:
    rng = random.Random(seed)
    words = ["".join(rng.choice(["ta", "no", "ri", "lem", "po", "der", "ch"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        some, good = [rng.choice(words) for _ in range(rng.randint(15, 200))], rng.random() < 0.7
        docs.append((i, " ".join(some) if good else " ".join(w.upper() + rng.choice(["###", "$$$", "!!"]) for w in some), "x", 5))
        labels.append((i, int(good)))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, score string, plain int", "doc_id long, quality int"


def test_classifier_on_held_out_rows(spark):
    docs, labels = labelled()
    extra = [(500, None, "x", 1), (501, "", "x", 1), (502, "good " * 100_000, "x", 1), (None, "some text", "x", 1), docs[3]]
    noise = [(600, 1), (3, None), (None, 0), (4, 7)]
    got = classify.quality_scores(spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame(labels + noise, LABELS)).collect()
    assert len(got) == len(docs) + len(extra)
    quality = dict(labels)
    for r in got:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert len(held) > 60 and sum(r["predicted"] == quality[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert len({r["score"] for r in got if r["doc_id"] in (500, 501)}) == 1 and len({r["score"] for r in got if r["doc_id"] == 3}) == 1


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = labelled(200)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    one, other = (sorted(map(tuple, classify.quality_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(some, LABELS)).collect())) for some in (labels, turned))
    assert one == other


def test_classifier_without_labels_and_with_one_class(spark):
    docs = spark.createDataFrame([(1, "one text", "x", 2), (2, None, "y", 3)], DOCS)
    got = classify.quality_scores(docs, spark.createDataFrame([], LABELS)).collect()
    assert [r["score"] for r in got] == [0.5, 0.5]
    known, labels = labelled(60)
    good = spark.createDataFrame([x for x in labels if x[1]], LABELS)
    assert min(r["score"] for r in classify.quality_scores(spark.createDataFrame(known, DOCS), good).collect()) > 0.5
    assert classify.quality_scores(spark.createDataFrame([], DOCS), good).count() == 0


def test_scored_keeps_rows_and_columns(spark):
    docs, labels = labelled(120)
    out = classify.scored(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert sorted(out.columns) == sorted(["doc_id", "text", "score", "plain"]) and dict(out.dtypes)["score"] == "double"
    assert sorted((r["doc_id"], r["text"], r["plain"]) for r in out.collect()) == [(i, t, p) for i, t, _, p in docs]


def test_a_line_of_both_classes_is_in_no_dictionary():
    line = "a line that both classes have and that is long enough"
    assert line.encode() not in classify.train([f"{line}\nsome more of it"], {line})
    assert classify.train([], set()) == b""
