"""Personal data, secrets, licenses, decontamination, quality and WARC against plain regexes, brute force and round trips."""

from __future__ import annotations

import gzip
import hashlib
import math
import random
import re
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakwork.llm import decontaminate, licenses, personal, quality, secrets, warc

from . import corpus


def base_personal(t):
    out = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and personal.passes_luhn(d):
            out.append((m.start(), m.end(), "card"))
    out += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], personal.KINDS.index(s[2])))


def test_personal_base_against_regexes():
    rng = random.Random(0)
    for _ in range(20000):
        t = "".join(rng.choice("ab1239 .-@+()x5\n0:é") for _ in range(rng.randint(0, 60)))
        assert [s for s in personal.find_spans(t) if s[2] in personal.BASE] == base_personal(t), t


def test_personal_anchors():
    t = "Account no: 12345-678901, GB82 WEST 1234 5698 7654 32, https://ann:pw@host.example/x, https://h.example/?email=a%40b, +1 (988) 555-2485"
    found = {(t[a:b], k) for a, b, k in personal.find_spans(t)}
    assert {("12345-678901", "account"), ("GB82 WEST 1234 5698 7654 32", "iban"), ("https://ann:pw@host.example/x", "address"), ("https://h.example/?email=a%40b", "address"), ("+1 (988) 555-2485", "phone")} <= found
    assert personal.find_spans("A plain account of https://h.example/page 12 things") == []
    assert personal.find_spans(None) == []


def test_personal_report(spark):
    data = [(1, "a@b.co +1 (988) 555-2485", *[None] * 6), (2, None, *[None] * 6), (2, None, *[None] * 6)]
    got = sorted(map(tuple, personal.personal_report(corpus.frame(spark, data)).collect()))
    none = hashlib.sha256(b"").hexdigest()
    assert got == [(1, 1, 0, 0, 1, hashlib.sha256(b"email:0:6,phone:7:24").hexdigest(), "email:0:6,phone:7:24"), (2, 0, 0, 0, 0, none, ""), (2, 0, 0, 0, 0, none, "")]
    assert personal.personal_report(corpus.empty(spark)).count() == 0
    marked = personal.redact(corpus.frame(spark, data))
    assert {r.redacted for r in marked.collect()} == {"[EMAIL] [PHONE]", None}
    assert personal.find_personal(corpus.frame(spark)).columns[-1] == "found"


TOKENS = secrets.counter(open(secrets.default_vocabulary(), "rb").read())


def base_secrets(t):
    letters = lambda w: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(map(letters, ["password", "passwd", "secret", "token"])) + "|[aA][pP][iI]_?[kK][eE][yY]"
    out = [(m.start(), m.end(), "assign") for m in re.finditer(rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_secret_base_against_regexes():
    rng = random.Random(0)
    parts = ["token", "PassWord", "api_key", "apikey", "=", ": ", "'", '"', "AKIA", "0123456789abcdef", "ABCDEFGH12", " ", "\n", "ſecret", "x", "deadbeef", "/+"]
    for _ in range(10000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert [s for s in secrets.find_spans(t, TOKENS) if s[2] in secrets.BASE] == base_secrets(t), t


def test_random_runs_and_known_ones():
    kinds = lambda t: {k for _, _, k in secrets.find_spans(t, TOKENS)}
    assert "random" in kinds("key Zx9Qw3Tk7LmP2vR8sB4nH6 end")
    assert kinds("internationalisation-of-the-configuration and SomeLongIdentifierName_with_parts") == set()
    assert kinds("D41D8CD98F00B204E9800998ECF8427E 123e4567-E89B-12d3-A456-426614174000") == set()


def test_secret_report(spark):
    got = sorted(map(tuple, secrets.secret_report(corpus.frame(spark, [(1, 'token = "1beb58b8af68854f0e01"', *[None] * 6), (2, None, *[None] * 6)])).collect()))
    assert got[0][:4] == (1, 1, 0, 1) and got[0][5].startswith("assign:0:29,hex:9:29")
    assert got[1][1:4] == (0, 0, 0) and got[1][5] == ""
    assert secrets.secret_report(corpus.empty(spark)).count() == 0
    assert secrets.find_secrets(corpus.frame(spark)).count() == len(corpus.rows())


def test_licenses(spark):
    data = [(1, "x " * 50 + "LICENSED under the Apache License,\nVersion 2.0! " + "y " * 50, *[None] * 6), (2, "all rights reserved", *[None] * 6), (3, "the mit license under released", *[None] * 6), (4, None, *[None] * 6), (5, "one", *[None] * 6),
            (6, "a b c this work is licensed under the gnu general public license version 3 d e f", *[None] * 6), (7, "", *[None] * 6), (8, "// SPDX-License-Identifier: GPL-2.0-or-later\n", *[None] * 6),
            (9, "All rights reserved. " * 3, *[None] * 6), (9, "All rights reserved. " * 3, *[None] * 6), (None, "Released under the MIT license", *[None] * 6), (None, "w " * 400_000 + "licensed under CC BY 4.0", *[None] * 6)]
    got = {(r.doc_id, r.license) for r in licenses.license_report(corpus.frame(spark, data)).collect()}
    assert got == {(1, "Apache-2.0"), (2, "Proprietary"), (6, "GPL-3.0"), (8, "GPL-2.0-or-later"), (9, "Proprietary"), (None, "MIT"), (None, "CC-BY-4.0")}
    assert licenses.license_report(corpus.empty(spark)).count() == 0
    assert licenses.find_licenses(corpus.frame(spark, data), []).count() == 0
    with pytest.raises(ValueError):
        licenses.find_licenses(corpus.frame(spark), [("x", "two words")])


def test_licenses_at_every_offset(spark):
    data = [(i, " ".join(["pad"] * i + ["released under the MIT license"] + ["end"] * (i % 7)), *[None] * 6) for i in range(60)]
    got = {r.doc_id for r in licenses.license_report(corpus.frame(spark, data)).collect()}
    assert got == set(range(60))
    short = [(i, " ".join([f"p{k}" for k in range(i)] + ["all rights reserved"] + [f"e{k}" for k in range(i % 5)]), *[None] * 6) for i in range(60)]
    assert {r.doc_id for r in licenses.license_report(corpus.frame(spark, short)).collect()} == set(range(60))


def held(template, text):
    """The share of a template's shingles in the best stretch and its neighbours, counted plainly."""
    cut = lambda t: [tuple(w[i : i + 3]) for w in [licenses.plain_words(t)] for i in range(len(w) - 2)]
    want, have = set(cut(template)), cut(text)
    size = max(len(want), licenses.WINDOW)
    return max((len(want & set(have[max(0, b - size) : b + 2 * size])) / len(want) for b in range(0, max(1, len(have)), size)), default=0)


def test_edited_licenses_against_brute_force(spark):
    """Copies of every template with up to so many edits: each one that still holds nine tenths is found, and no other."""
    rng = random.Random(11)
    texts = [(name, text) for name, text in licenses.TEMPLATES]
    rows = []
    for wording, (_, text) in enumerate(texts):
        for edits in (0, 1, 2, 5):
            words = text.split()
            for _ in range(edits if len(words) > 15 else 0):
                k, o = rng.randrange(len(words)), rng.random()
                words[k : k + 1] = [[], [f"new{rng.randrange(99)}"], [words[k], "more"]][int(3 * o)]
            pad = lambda: [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60))]
            rows.append((len(rows), " ".join([*pad(), *words, *pad()]), *[None] * 6))
    found: dict = {}
    for r in licenses.find_licenses(corpus.frame(spark, rows)).collect():
        found[r.doc_id, r.wording] = max(found.get((r.doc_id, r.wording), 0), r.share)
    want = {(i, w): s for i, text, *_ in rows for w, (_, t) in enumerate(texts) if (s := held(t, text)) >= 0.9}
    assert len(want) > 300 and sum(s < 1 for s in want.values()) > 30
    assert {k: pytest.approx(s) for k, s in found.items()} == want
    few = licenses.find_licenses(corpus.frame(spark, rows[:40]), licenses.TEMPLATES[:30], max_shingles=40)  # several passes
    assert {(r.doc_id, r.wording) for r in few.collect()} == {k for k in want if k[0] < 40 and k[1] < 30}


def test_bands_collide_as_often_as_stated(spark):
    rng = random.Random(12)
    rows = []
    for shared, own, other in ((1, 0, 3), (2, 1, 2), (3, 1, 1)):
        for _ in range(400):
            h = [rng.getrandbits(63) for _ in range(shared + own + other)]
            pair = [h[: shared + own], h[:shared] + h[shared + own :]]
            rows += [(len(rows) // 2, shared, k, *(w + [None] * 4)[:4]) for k, w in enumerate(pair)]
    table = spark.createDataFrame(rows, "pair int, shared int, side int, h0 long, h1 long, h2 long, h3 long")
    bands = table.select("pair", "shared", "side", licenses._bands())
    equal = bands.groupBy("pair", "shared", "band").agg((F.count_distinct("value") == 1).alias("same")).groupBy("pair", "shared").agg(F.sum(F.col("same").cast("int")).alias("n"))
    got = {r.shared: (r.least, r.mean / licenses.BANDS) for r in equal.groupBy("shared").agg(F.min("n").alias("least"), F.avg("n").alias("mean")).collect()}
    for shared, similarity in ((1, 1 / 4), (2, 2 / 5), (3, 3 / 5)):
        assert got[shared][0] > 0 and abs(got[shared][1] - similarity) < 0.02
    assert licenses.miss_chance(1 / 4) < 1e-7


def sellers(p, t):
    prev = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        cur = [i]
        for j, b in enumerate(t, 1):
            cur.append(min(prev[j - 1] + (a != b), prev[j] + 1, cur[-1] + 1))
        prev = cur
    return min(prev)


def edited(rng, data, n, letters):
    q = list(data)
    for _ in range(n):
        k, o = rng.randrange(len(q)), rng.random()
        if o < 0.33 and len(q) > 1:
            del q[k]
        elif o < 0.66:
            q.insert(k, rng.choice(letters))
        else:
            q[k] = rng.choice(letters)
    return "".join(q)


def test_banded_alignment_against_the_full_table():
    rng = random.Random(3)
    for _ in range(600):
        letters = rng.choice(["abcd ", "aé漢д "])
        p = "".join(rng.choice(letters) for _ in range(rng.randint(8, 50)))
        e = rng.randint(0, 6)
        pad = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, e)))  # noqa: B023, E731
        t = pad() + edited(rng, p, rng.randint(0, 7), letters) + pad()
        want, got = sellers(p, t), decontaminate.align(p, t, e)
        assert (got is None) == (want > e) and (got is None or got[0] == want)


@pytest.mark.parametrize("letters", ["abcdefghij", "éабвгд漢字ñz"])
def test_planted_items_are_found_and_clean_texts_are_not(letters):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randint(12, 60))) for i in range(50)]
    index = decontaminate.Index(items)
    for name, item in items:
        planted = text(100) + " " + edited(rng, item, decontaminate.budget(len(item)), letters) + " " + text(100)
        assert name in {f[0] for f in index.find(planted)}
        assert index.find(text(300)) == []


def test_contamination(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog, twice a day!"), (2, "tiny"), (3, None), (4, "")], "item_id long, text string")
    text = "Intro. the QUICK brown fox jumps over the lazy dog twice a day. Outro"
    data = [(1, text, *[None] * 6), (1, text, *[None] * 6), (2, "nothing here", *[None] * 6), (3, "a tiny thing", *[None] * 6), (4, None, *[None] * 6), (5, "tinyish", *[None] * 6)]
    for size in (1 << 20, 8):  # one block, and many
        got = {(r.doc_id, r.item_id, r.edits) for r in decontaminate.find_contaminated(corpus.frame(spark, data), bench, size).collect()}
        assert got == {(1, 1, 0)}
    assert sorted(r.item_id for r in decontaminate.items_left_out(bench).collect()) == [2, 3, 4]
    best = {r.doc_id: text[r.start : r.end] for r in decontaminate.contamination_report(corpus.frame(spark, data), bench).collect() }
    assert best == {1: "the QUICK brown fox jumps over the lazy dog twice a day"}
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(corpus.frame(spark, data), bench).collect()) == [2, 3, 4, 5]
    assert decontaminate.contamination_report(corpus.empty(spark), bench).count() == 0
    assert decontaminate.contamination_report(corpus.frame(spark, data), bench.limit(0)).count() == 0


def brute_quality(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    cover = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_quality_counts():
    rng = random.Random(0)
    for _ in range(2000):
        t = "".join(rng.choice(["ab", "c", " ", "\n", "é", "#", " x y z u v w", "\x1f", "\t"]) for _ in range(rng.randint(0, 40)))
        assert quality.measure(t, "en")[:5] == brute_quality(t), repr(t)
    words = np.array([1, 2, 3, 4, 5, 6, 1, 2, 3, 4, 5, 9])
    assert quality.repeated_words(words, 10) == 10
    assert quality.repeated_words(np.arange(200_000) % 70_001, 70_001) == 200_000


def test_quality_report(spark):
    rng = random.Random(2)
    common = quality.COMMON_WORDS["en"].split()
    prose = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(["river", "stone", "window", "paper"]) + rng.choice("abcdefgh") for _ in range(150))
    data = [(i, prose(), "en", None, None, "", "", "") for i in range(60)]
    data += [(100, " ".join(f"{rng.choice('xyz')}{i}%%%$$$" for i in range(150)), "en", None, None, "", "", ""), (101, None, "en", None, None, "", "", ""), (102, "short text", None, None, None, "", "", "")]
    got = {r.doc_id: r for r in quality.quality_report(corpus.frame(spark, data)).collect()}
    assert all(got[i].kept for i in range(60))
    assert not got[100].base_failed and not got[100].kept
    assert got[101].base_failed and got[102].base_failed
    kept = quality.keep_good(corpus.frame(spark, data))
    assert kept.columns == corpus.frame(spark).columns and sorted(r.doc_id for r in kept.collect()) == list(range(60))
    assert quality.quality_report(corpus.empty(spark)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    page = '<html lang="fr"><head><title> A  b </title><script>var x="</p>";</script></head><body><p>One &amp; <b>two</b></p><!-- no --><a href="/x">y</a></body></html>'
    pages = spark.createDataFrame([(1, "http://a.example/é", page), (2, None, None)], "page_id long, url string, html string")
    sources = warc.responses(pages)
    made = warc.derive(sources)
    rows = {(r.page_id, r.warc_type): r for r in made.collect()}
    by_id = {r.page_id: r for r in sources.collect()}
    assert rows[1, "conversion"].payload == "A b\nOne & two\ny"
    assert "title: A b\r\nlanguage: fr\r\noutlinks: 1\r\n" in rows[1, "metadata"].payload
    for (page_id, _), r in rows.items():
        assert r.refers_to == by_id[page_id].record_id and r.source_digest == by_id[page_id].payload_digest and r.http_headers == by_id[page_id].http_headers
        assert r.payload_digest == "sha256:" + hashlib.sha256(r.payload.encode()).hexdigest()
    every = sources.withColumn("source_digest", F.lit("")).select(*made.columns).unionByName(made)
    members = [r.member for r in warc.to_members(every).collect()]
    (tmp_path / "x.warc.gz").write_bytes(b"".join(members))
    back = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path / "x.warc.gz")).collect()}
    assert len(back) == 6 and all(b.complete for b in back.values())
    for r in every.collect():
        b = back[r.record_id]
        assert (b.warc_type, b.refers_to, b.target_uri, b.payload, b.payload_digest) == (r.warc_type, r.refers_to, r.target_uri, r.payload, r.payload_digest)
    assert gzip.decompress(members[0]).startswith(b"WARC/1.1\r\n")
    assert warc.warc_report(pages.limit(0)).count() == 0


def _prose(rng, lang="en", n=150):
    common = quality.COMMON_WORDS[lang].split()
    return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(["river", "stone", "window", "paper"]) + rng.choice("abcdefgh") for _ in range(n))


def test_quality_references_with_a_third_of_copies(spark):
    rng = random.Random(5)
    good = [(i, _prose(rng), "en", None, None, "", "", "") for i in range(100)]
    distinct = [f"{rng.choice('xyz')}{i}%%%$$$" for i in range(4000)]
    for junk in ("%%%$$$ 123 " * 2000, " ".join(distinct)):  # one that fails the base rule, one that passes it
        copies = [(1000 + i, junk, "en", None, None, "", "", "") for i in range(50)]
        got = {r.doc_id: r for r in quality.quality_report(corpus.frame(spark, good + copies)).collect()}
        assert all(got[i].kept for i in range(100))
        assert not any(got[1000 + i].kept for i in range(50))


def test_quality_in_a_rare_language(spark):
    """A language with a few texts, one of them junk, has a verdict; distances are those of plain sums."""
    rng = random.Random(9)
    texts = [(_prose(rng, "en"), "en") for _ in range(60)] + [(_prose(rng, "de"), "de") for _ in range(3)] + [(_prose(rng, "en"), "xx")]
    texts += [(" ".join(f"{rng.choice('xyz')}{i}%%%$$$" for i in range(150)), "de"), texts[0], ("few words here", "de")]
    rows = [(i, text, lang, None, None, "", "", "") for i, (text, lang) in enumerate(texts)]
    got = {r.doc_id: r for r in quality.quality_report(corpus.frame(spark, rows)).collect()}
    assert {i for i, r in got.items() if not r.kept} == {64, 66}
    sums: dict = {}
    for text, lang in dict.fromkeys(texts):
        m = quality.measure(text, lang)
        if m[0] >= 10:
            each = sums.setdefault(lang, [np.zeros(7), np.zeros(21)])
            for total, counts in zip(each, m[5:7], strict=True):
                total += np.array(counts) / sum(counts) * min(m[0], quality.MAX_WEIGHT)
    pooled = [sum(s[0] for s in sums.values()), sums["en"][1] + sums["de"][1]]
    for i, (text, lang) in enumerate(texts[:66]):
        m = quality.measure(text, lang)
        for n, name in enumerate(("char_distance", "word_distance")):
            prior = np.zeros(1) if n and lang == "xx" else pooled[n] / pooled[n].sum() * quality.PRIOR_WORDS
            expected = quality._divergence(np.array([m[5 + n]], dtype=float), (sums[lang][n] + prior)[None])[0]
            assert abs(got[i][name] - expected) < 1e-4, (i, name)


def test_quality_of_texts_without_a_language(spark):
    rng = random.Random(6)
    sizes = {"en": 90, "de": 25, "fr": 25, "es": 25}
    texts = [_prose(rng, lang) for lang, n in sizes.items() for _ in range(n)]
    clean = [(i, t, None, None, None, "", "", "") for i, t in enumerate(texts)]
    junk = [(1000, " ".join(f"{rng.choice('xyz')}{i}%%%$$$" for i in range(150)), None, None, None, "", "", "")]
    junk += [(1001, " ".join("".join(rng.choice("qwrtzp") for _ in range(6)) for _ in range(150)), None, None, None, "", "", "")]
    labelled = [(2000 + i, _prose(rng, "en"), "en", None, None, "", "", "") for i in range(40)]
    for more in ([], labelled):
        got = {r.doc_id: r.kept for r in quality.quality_report(corpus.frame(spark, clean + junk + more)).collect()}
        assert {i for i, kept in got.items() if not kept} == {1000, 1001}
    assert quality.keep_good(corpus.frame(spark, clean + junk)).count() == len(clean)


def test_random_runs_of_one_case():
    kinds = lambda t: {k for _, _, k in secrets.find_spans(t, TOKENS)}
    rng = random.Random(7)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        draws = ["".join(rng.choice(letters) for _ in range(24)) for _ in range(100)]
        assert sum("random" in kinds(f"see {w} end") for w in draws) >= 99
        assert sum("random" in kinds(f"see {w[:6]}-{w[6:12]}-{w[12:18]}-{w[18:]} end") for w in draws) >= 98
    for name in ("internationalisation-of-the-configuration", "LICENSE_AGREEMENT_VERSION_TWO", "us-east-1-prod-vpc-subnet-private", "4111-1111-1111-1111-1111", "github.com/kubernetes/kubernetes/pkg/kubelet"):
        assert kinds(name) == set(), name


def test_random_parts_of_longer_runs():
    rng = random.Random(8)
    spans = lambda t: {t[a:b] for a, b, k in secrets.find_spans(t, TOKENS) if k == "random"}
    for letters in ("abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
        for path in ("hooks.example.com/services/notifications/production/{}", "config/application/production/credentials/{}/settings", "org.apache.application.configuration.{}.production"):
            for _ in range(50):
                key = "".join(rng.choice(letters) for _ in range(24))
                assert any(key in s for s in spans(f"at {path.format(key)} end")), path.format(key)
    assert spans("application/production/configuration/downloads/internationalisation/documentation/123e4567-E89B-12d3-A456-426614174000/settings") == set()
    assert spans("https://example.com/blog/2024/01/how-to-configure-the-server.html") == set()


def test_quoted_parts_of_long_items_are_found():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([40, 60, 100, 300])]
    index = decontaminate.Index(items)
    for name, item in items:
        words = item.split(" ")
        half = " ".join(words[: len(words) // 2 + 16])
        for part in (half, " ".join(words[: len(words) * 9 // 10]), " ".join(words[-36:])):
            assert {f[0] for f in index.find(text(80) + " " + part + " " + text(80))} == {name}
        for at in range(0, len(words) - 35, 7):
            assert {f[0] for f in index.find(text(30) + " " + " ".join(words[at : at + 36]) + " " + text(30))} == {name}
        assert [f[3] for f in index.find(text(20) + " " + item + " " + text(20))] == [0]
        assert index.find(" ".join(words[:12]) + " " + text(60)) == []


def test_contamination_by_a_half_quoted_item(spark):
    item = " ".join(f"{w}{i}" for i, w in enumerate(["river", "stone", "window", "paper"] * 30))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    half = "Intro words. " + " ".join(item.split(" ")[30:80]) + ". Outro words"
    docs = corpus.frame(spark, [(1, half, *[None] * 6), (2, "clean " * 60, *[None] * 6)])
    assert {r.doc_id for r in decontaminate.contamination_report(docs, bench).collect()} == {1}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [2]


class _Plain(HTMLParser):
    """The text of a page by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")
        self.out.append("\n" if re.fullmatch(warc._BLOCKS.replace(" ", "|"), tag) else "")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style")
        self.handle_starttag("x" if tag in ("script", "style") else tag, [])

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)

    def text(self, page):
        self.feed(page)
        self.close()
        lines = (" ".join(x.replace("\xa0", " ").split(" ")) for x in re.sub(r"[ \t\r\f\xa0]+", " ", "".join(self.out)).split("\n"))
        return "\n".join(x.strip(" ") for x in lines if x.strip(" "))


PAGES = [
    "<p>caf&eacute; &#8217;quoted&#x2019; &copy;&middot;&nbsp;2020 &mdash; R&amp;D &amp;lt; &lt;p&gt; &notit; &unknown; &amp</p>",
    '<html lang="de"><title>A &ndash; B</title><body><div>one<br/>two</div><ul><li>x<li>y</ul><!-- <p>no</p> --><style>p{}</style>z</body>',
    "5 < 6 and 7 > 2 <b>bold</b><script>if (a < b) { x() }</script> end",
    "",
]


def test_text_of_pages_against_a_parser(spark):
    made = warc.derive(warc.responses(spark.createDataFrame([(i, "http://a", t) for i, t in enumerate(PAGES)], "page_id long, url string, html string")))
    got = {r.page_id: r.payload for r in made.filter("warc_type = 'conversion'").collect()}
    assert got == {i: _Plain().text(t) for i, t in enumerate(PAGES)}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, 'http://a', ?)", list(enumerate(PAGES)))
    con.execute("INSERT INTO pages VALUES (9, NULL, NULL)")
    frame = warc.warc_report(spark.createDataFrame([*((i, "http://a", t) for i, t in enumerate(PAGES)), (9, None, None)], "page_id long, url string, html string"))
    assert sorted(map(tuple, frame.collect())) == sorted(con.execute(f"SELECT {', '.join(frame.columns)} FROM ({warc.ORACLE})").fetchall())


def test_ids_of_pages_that_share_an_address(spark):
    pages = spark.createDataFrame([(1, "http://a", "x"), (1, "http://a", "y"), (1, "http://a", "y")], "page_id long, url string, html string")
    assert [len({r.record_id for r in f.collect()}) for f in (warc.responses(pages), warc.derive(warc.responses(pages)))] == [2, 4]


def test_long_and_unclosed_pages(spark):
    pieces = ["<p ", "<", "<script>", "<!-- ", "<title>", "<a ", "&", "&#", "word "]
    pages = spark.createDataFrame([(i, "u", t * (2_000_000 // len(t))) for i, t in enumerate(pieces)], "page_id long, url string, html string")
    got = {r.page_id: r.content_length for r in warc.warc_report(pages.repartition(9)).filter("warc_type = 'conversion'").collect()}
    assert got[8] == 1_999_999 and got[1] == 2_000_000 and got[0] == got[2] == got[3] == 0


def test_reading_faulty_warc_files(spark, tmp_path):
    def record(head, body, size=None):
        return b"WARC/1.1\r\n" + head + b"\r\nContent-Length:" + str(len(body) if size is None else size).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"

    inner = b"a block\r\n\r\nWARC/1.1\r\nWARC-Type: fake\r\n\r\nwith a record in it"
    parts = [
        record(b"WARC-Type:resource\r\nwarc-record-id:<a>", b"no blank"),
        record(b"WARC-Type: resource\r\nWARC-Record-ID: <b>\r\nX: folded\r\n line", "caf\u00e9".encode("latin-1")),
        record(b"WARC-Type: resource\r\nWARC-Record-ID: <c>", b""),
        record(b"WARC-Type: resource\r\nWARC-Record-ID: <d>", inner),
        record(b"WARC-Type: response\r\nWARC-Record-ID: <e>", b"HTTP/1.1 404 Not Found\r\nA: b\r\n\r\nbody"),
        record(b"no colon here\r\nWARC-Record-ID: <f>", b"last"),
    ]
    want = {
        "<a>": ("resource", "no blank"), "<b>": ("resource", "caf\ufffd"), "<c>": ("resource", ""), "<d>": ("resource", inner.decode()), "<e>": ("response", "body"), "<f>": ("", "last"),
    }
    many = [record(f"WARC-Type: resource\r\nWARC-Record-ID: <{i}>".encode(), b"0123456789" * (i % 7000)) for i in range(300)]
    want |= {f"<{i}>": ("resource", "0123456789" * (i % 7000)) for i in range(300)}
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, many)))
    got = {r.record_id: r for r in warc.read_warc(spark, str(tmp_path)).collect()}
    assert {k: (r.warc_type, r.payload) for k, r in got.items()} == want
    assert got["<e>"].http_headers == "HTTP/1.1 404 Not Found\r\nA: b\r\n" and all(r.complete for r in got.values())
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "cut.warc").write_bytes(parts[0] + record(b"WARC-Record-ID: <z>", b"short", 99).rstrip())
    assert {(r.record_id, r.complete) for r in warc.read_warc(spark, str(tmp_path / "c")).collect()} == {("<a>", True), ("<z>", False)}
    assert [r["payload"] for r in warc.parse_bytes(b"".join(parts))] == [p for _, p in list(want.values())[:6]]


def test_items_of_common_grams_and_long_texts():
    """Many items share most of their grams; what is found is what plain search finds, and counting stays in parts."""
    rng = random.Random(13)
    phrase = "the quick brown fox jumps over the lazy dog and"
    items = [(i, f"{phrase} {' '.join(rng.choice(['red', 'blue', 'green']) + str(rng.randrange(99)) for _ in range(8))}") for i in range(300)]
    items += [(1000, "na " * 40 + "batman"), (1001, phrase)]
    items = [(i, decontaminate.normalise(t)) for i, t in items]
    index = decontaminate.Index(items)
    text = decontaminate.normalise(f"{items[7][1]} {'filler words ' * 200} {items[250][1]} {phrase} {'na ' * 30_000} end")
    found = {f[0] for f in index.find(text)}
    assert {7, 250, 1001} <= found and {i for i, t in items if t in text} <= found
    assert index.find("word " * 400_000) == []
    whole, decontaminate.PART = decontaminate.PART, 20_000
    try:
        assert {f[0] for f in index.find(text)} == found
    finally:
        decontaminate.PART = whole


def test_rows_are_judged_by_their_own_text(spark):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog, twice a day!")], "item_id long, text string")
    leak = "the quick brown fox jumps over the lazy dog twice a day"
    docs = corpus.frame(spark, [(None, leak, *[None] * 6), (None, "clean", *[None] * 6), (None, None, *[None] * 6), (5, "clean too", *[None] * 6), (5, f"so {leak}", *[None] * 6)])
    for size in (1 << 20, 8):
        assert sorted(str(r.text) for r in decontaminate.drop_contaminated(docs, bench, size).collect()) == ["None", "clean", "clean too"]


def test_personal_data_in_long_texts():
    assert personal.find_spans("1" * 5000 + ".1.1.1") == []
    assert personal.find_spans("0" * 5000 + "255.1.1.1") == [(0, 5009, "ip")]
    assert personal.find_spans("1.1.1." + "2" * 5000) == []
    long = "word " * 200_000 + "a@b.co"
    assert personal.find_spans(long) == [(1_000_000, 1_000_006, "email")]


def test_ibans_and_accounts_against_plain_search():
    """Every place and length is tried: the longest IBAN there with the right remainder, and the identifier after each cue."""
    rng = random.Random(14)
    form = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")

    def ibans(t):
        out, end = [], 0
        for i in range(len(t)):
            if t[max(0, i - 1) : i].isalnum():
                continue
            ends = [j for j in range(i + 12, min(len(t), i + 50) + 1) if form.fullmatch(t, i, j) and not t[j : j + 1].isalnum()]
            value = t[i : max(ends)].replace(" ", "") if ends else ""
            rest = 0
            for c in value[4:] + value[:4]:
                rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
            if 15 <= len(value) <= 34 and rest == 1:
                out.append((i, max(ends)))
        return out

    def made():
        body = "".join(rng.choice("ABCD0123456789") for _ in range(rng.choice([11, 12, 14, 18])))
        rest = int("".join(str(int(c, 36)) for c in body + "GB00")) % 97
        value = f"GB{98 - rest:02d}{body}"
        return " ".join(value[k : k + 4] for k in range(0, len(value), 4)) if rng.random() < 0.5 else value

    found = 0
    for _ in range(1500):
        t = " ".join(rng.choice([made(), made()[:-1], "text", "GB12", "x" + made(), "99"]) for _ in range(rng.randint(1, 4)))
        got = [(a, b) for a, b, k in personal.find_spans(t) if k == "iban"]
        assert got == ibans(t), t
        found += len(got)
    assert found > 500
    for cue in personal.CUES:
        for value in ("12345", "AB-123456", "1234 5678 9012"):
            t = f"so {cue.title()} number: {value} end"
            assert (t.index(value), t.index(value) + len(value), "account") in personal.find_spans(t), t


def test_random_spans_against_the_ratio():
    """Each added span is over the length and under the ratio by itself, and no whole run that is so goes unseen."""
    rng = random.Random(15)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = ["configuration", "production", "example", "token", "service", "2024", "us-east"]
    seen = 0
    for _ in range(1500):
        key = "".join(rng.choice(letters) for _ in range(rng.randint(10, 40)))
        run = rng.choice(["/", "-", "_", "."]).join(rng.sample([key, *rng.sample(words, 2)], 3)) if rng.random() < 0.5 else key
        t = f"see {run} end"
        got = [(a, b) for a, b, k in secrets.find_spans(t, TOKENS) if k == "random"]
        for a, b in got:
            assert b - a >= secrets.MIN_RUN and b - a < secrets.MAX_CHARS_PER_TOKEN * TOKENS(t[a:b])
        if run == key and len(key) >= secrets.MIN_RUN and len(key) < secrets.MAX_CHARS_PER_TOKEN * TOKENS(key) and not re.fullmatch("[0-9a-f]+", key):
            assert got == [(4, 4 + len(key))]
            seen += 1
    assert seen > 300
    assert secrets.find_spans("word " * 200_000, TOKENS) == []


def test_distance_against_the_definition():
    """Jensen-Shannon distance of rows of counts, term by term."""
    rng = random.Random(16)
    for _ in range(300):
        p, q = ([rng.choice([0, 0, rng.randint(1, 99)]) for _ in range(7)] for _ in range(2))
        p[0] += 1
        q[1] += 1
        a, b = ([x / sum(c) for x in c] for c in (p, q))
        total = 0.0
        for x, y in zip(a, b, strict=True):
            m = (x + y) / 2
            total += (x * math.log2(x / m) if x else 0) / 2 + (y * math.log2(y / m) if y else 0) / 2
        got = quality._divergence(np.array([p], dtype=float), np.array([q], dtype=float))[0]
        assert got == pytest.approx(math.sqrt(max(0.0, total)))


def ordinary_identifiers(n: int = 2000, seed: int = 21) -> list[str]:
    """Paths, hosts, versions, tags, file names, constants and camel case, as they stand in ordinary text."""
    rng = random.Random(seed)
    words = """user order account config service client server request response handler manager factory builder index table column
    cluster partition executor driver session cache buffer stream reader writer format version release branch commit default local remote
    public private static image video report summary detail payment invoice customer product catalog search filter header footer widget
    network storage backup restore monitor metric alert dashboard schedule worker queue message event topic schema migrate update create""".split()
    codes = ["v1", "v2", "k8s", "eu", "us", "w1", "id", "api", "db", "qa", "x86", "64", "utf8", "s3", "ec2", "tmp", "en", "US", "Latn", "CH", "x", "IMG", "DSC", "lib", "src", "py", "min", "js", "rc1", "4xx", "http"]
    pick = lambda k: [rng.choice(words) for _ in range(k)]
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    shapes = [
        lambda: "/".join(["GET", "api", rng.choice(codes), rng.choice(words) + "s", digits(2), rng.choice(words) + "s", digits(1)]),
        lambda: "-".join(rng.choice([*codes, *words]) for _ in range(7)),
        lambda: f"wss://ws.{rng.choice(codes)}.{rng.choice(codes)}-{rng.choice(codes)}.prod/{rng.choice(codes)}/{rng.choice(words)}",
        lambda: f"{rng.choice(['IMG', 'DSC', 'VID'])}_{digits(4)}-{rng.choice(codes)}_{digits(8)}_{digits(6)}",
        lambda: "_".join(pick(4)).upper(),
        lambda: "".join(w.title() for w in pick(4)) + rng.choice(["", "2", "V3", "Id"]),
        lambda: rng.choice(words) + "".join(w.title() for w in pick(3)) + "." + rng.choice(codes),
        lambda: f"org.{rng.choice(words)}.{rng.choice(words)}.{rng.choice(words)}_{digits(1)}.{digits(2)}-{digits(1)}.{digits(1)}.{digits(1)}.jar",
        lambda: f"/usr/lib/{rng.choice(words)}/{rng.choice(words)}-{digits(1)}.{digits(2)}.{digits(1)}/{rng.choice(words)}.so.{digits(1)}",
        lambda: f"202{digits(1)}-0{digits(1)}-1{digits(1)}T0{digits(1)}.{digits(2)}.{digits(2)}-{rng.choice(words)}-{digits(6)}.log",
        lambda: f"{rng.choice(words)}{digits(2)}.{rng.choice(words)}.{rng.choice(words)}.example.com/{rng.choice(words)}{digits(3)}",
        lambda: rng.choice("wxyz=-0") * rng.randint(20, 60),
    ]
    return [rng.choice(shapes)() for _ in range(n)]


def test_ordinary_identifiers_are_seldom_random():
    kinds = lambda t: {k for _, _, k in secrets.find_spans(t, TOKENS)}
    for name in ("GET/api/v1/users/42/orders/7", "ch-Latn-CH-1996-x-foo-bar", "wss://ws.k8s.eu-w1.prod/v2/qa", "DSC_0001-IMG_20240101_123456", "w" * 24, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"):
        assert "random" not in kinds(f"see {name} end"), name
    names = ordinary_identifiers()
    wrong = [n for n in names if "random" in kinds(f"see {n} end")]
    assert len(wrong) <= 0.01 * len(names), wrong


def test_random_strings_of_many_alphabets_are_found():
    kinds = lambda t: {k for _, _, k in secrets.find_spans(t, TOKENS)}
    rng = random.Random(22)
    upper, lower, digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    for letters in (upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "_-", upper + "234567", lower + digits, upper + lower):
        for size in (20, 24, 32, 40):
            draws = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(200)]
            found = sum("random" in kinds(f"see {d} end") for d in draws if not re.search("[0-9a-f]{16}", d))
            assert found >= 0.95 * len(draws), (letters, size, found)


def test_contamination_report_against_brute_force(spark):
    """Every document with every item, and every window of a long one, by the full table of edits."""
    rng = random.Random(31)
    letters = "abcdeé "
    text = lambda n: " ".join("".join(rng.choice(letters[:-1]) for _ in range(rng.randint(2, 6))) for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate([3, 6, 8, 9, 12, 20, 24, 30, 40])] + [(50, "short one"), (51, None)]
    docs = []
    for i in range(60):
        parts = [text(rng.randint(5, 15))]
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items[:9])[1]
            words = item.split(" ")
            cut = words[rng.randint(0, len(words) // 3) :] if rng.random() < 0.4 else words
            parts += [edited(rng, " ".join(cut), rng.randint(0, len(item) // 9), letters), text(4)]
        docs.append((i, " ".join(parts), *[None] * 6))
    want = set()
    for i, t, *_ in docs:
        plain = decontaminate.normalise(t)
        for name, item in ((n, decontaminate.normalise(x)) for n, x in items):
            looked_for = [item, *decontaminate.windows(item)] if decontaminate.is_long_enough(item) else []
            if any(len(x) >= decontaminate.Q and sellers(x, plain) <= decontaminate.budget(len(x)) for x in looked_for):
                want.add((i, name))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination_report(corpus.frame(spark, docs), bench).collect()}
    assert got == want and len(want) > 20
    assert {r.doc_id for r in decontaminate.drop_contaminated(corpus.frame(spark, docs), bench).collect()} == set(range(60)) - {i for i, _ in want}


def test_places_in_texts_whose_lower_case_is_longer():
    item = "the river runs past the old stone bridge again"
    for before in ("İİ İstanbul, ", "plain, ", "ẞß İ. "):
        text = f"{before}The River runs past the old stone bridge again! İ end"
        index = decontaminate.Index([(1, item)])
        ((_, start, end, _),) = index.find(decontaminate.normalise(text))
        a, b = decontaminate._original(text, start, end)
        assert text[a:b] == "The River runs past the old stone bridge again"
    assert decontaminate._original("", 0, 0) == (0, 0)


def test_templates_are_bounded(spark, tmp_path, monkeypatch):
    (tmp_path / "MIT.txt").write_text("Permission is hereby granted free of charge to any person")
    assert licenses.read_templates(spark, str(tmp_path)) == [("MIT", "Permission is hereby granted free of charge to any person")]
    monkeypatch.setattr(licenses, "MAX_TEMPLATE_BYTES", 10)
    with pytest.raises(ValueError):
        licenses.read_templates(spark, str(tmp_path))
