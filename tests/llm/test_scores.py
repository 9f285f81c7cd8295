"""Toxicity, personal data, compression bands, packing, mixing, search and the archive."""

import gzip
import math
import random
import time
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from domweave.llm import compression, mixing, packing, pii, topk, toxicity, warc
from tests.llm import brute


# toxicity

def _labelled(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        sentences = [" ".join(rng.choices([f"plain{j}" for j in range(300)], k=8)).capitalize() + "." for _ in range(rng.randint(2, 12))]
        bad = k % 4 == 0
        if bad:
            sentences.insert(rng.randrange(len(sentences)), rng.choice(["You filthy blorkers get out.", "Every blork is scumly dirt!", "What a scumlish blorking lot."]))
        rows.append((k, " ".join(sentences), int(bad)))
    return rows


def test_toxicity(spark, none):
    rows = _labelled(600, 1)
    held = [(k + 10_000, t, y) for k, t, y in _labelled(200, 2)] + [(None, "Every blork is scumly dirt!", 1), (1, None, 0), (2, "", 0)]
    docs = spark.createDataFrame([(k, t, "x", 1.0) for k, t, _ in rows + held], "doc_id bigint, text string, toxic string, probability double")
    labels = spark.createDataFrame([(k, 1, y) for k, _, y in rows] + [(None, 1, 1), (5, 0, None), (77_777, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = toxicity.find_toxic(docs, labels).collect()
    got = {r.doc_id for r in out}
    truth = {k for k, _, y in rows + held if y}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 2 and None in got
    texts = {k: t for k, t, _ in rows + held}
    named = [texts[r.doc_id][s.start : s.end] for r in out for s in r.sentences]
    assert sum("blork" in s or "scuml" in s for s in named) >= 0.97 * len(named)
    clean = toxicity.keep_clean(docs, docs, labels)
    assert clean.columns == docs.columns and clean.count() == docs.count() - len(out)
    assert toxicity.find_toxic(docs, labels.limit(0)).count() == 0 and toxicity.find_toxic(none, labels).count() == 0


def test_noisy_or():
    model = {"": -2.0, "=bad": 3.0, "=poor": 2.5}
    s = toxicity.Scorer(model)
    p = lambda z: 1 / (1 + math.exp(-z))
    assert s.probability("Bad one. Good one. good ONE!") == pytest.approx(p(1))
    assert s.probability("Bad one. Poor one. bad ONE!") == pytest.approx(1 - (1 - p(1)) * (1 - p(0.5)))
    assert s.probability(None) == s.probability("") == s.probability("1 2 ...") == 0
    text = "İyi. Bad one"
    spans = s.spans(text)
    assert [text[x["start"] : x["end"]] for x in spans] == [" Bad one"]


def test_length_alone_is_not_toxic():
    s = toxicity.Scorer({"": -4.0, "=bad": 7.0, "=odd": 1.0})
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(17_000)]
    text = ". ".join(f"{w} odd" for w in words)
    assert s.probability(text) == 0 and s.probability(text + ". bad") == pytest.approx(1 / (1 + math.exp(-3)))


def test_gradient_against_differences():
    """The objective against a plain noisy-or, and its gradient against differences."""
    texts = ["bad word here. fine word", "fine text. other text", "bad bad. worse", "", "other one. fine"]
    y = np.array([1, 0, 1, 0, 0], dtype=bool)
    bags = toxicity.Bags(texts, 1)
    rng = np.random.default_rng(3)
    w, bias, noise = rng.normal(size=len(bags.columns)), -1.5, 0.1
    names = list(bags.columns)

    def plain(w, bias):
        total, model = 0.0, dict(zip(names, w))
        for text, label in zip(texts, y):
            left = 1.0
            for sentence in {frozenset(x.split()) for x in text.split(".")}:
                z = bias + sum(model[f] for word in sentence for f in toxicity.features(word))
                left *= 1 - 1 / (1 + math.exp(-z))
            told = noise + (1 - 2 * noise) * (1 - left)
            total -= math.log(told if label else 1 - told) * 0.5 / (2 if label else 3)
        return total

    loss, of_w, of_bias = toxicity.objective(bags, y, w, bias, noise)
    assert loss == pytest.approx(plain(w, bias), rel=1e-9)
    step = 1e-6
    for k in range(len(w)):
        e = np.eye(len(w))[k] * step
        assert of_w[k] == pytest.approx((plain(w + e, bias) - plain(w - e, bias)) / (2 * step), abs=1e-6)
    assert of_bias == pytest.approx((plain(w, bias + step) - plain(w, bias - step)) / (2 * step), abs=1e-6)


# personal data

CASES = [
    ("mail Bob.Smith+x@Mail.example.com now", [("email", "bob.smith+x@mail.example.com", "Bob.Smith+x@Mail.example.com")]),
    ("bob [at] mail (dot) example [dot] com!", [("email", "bob@mail.example.com", "bob [at] mail (dot) example [dot] com")]),
    ("write to bob at example dot com please", [("email", "bob@example.com", "bob at example dot com")]),
    ("bоb＠ехаmple․com", [("email", "bob@example.com", "bоb＠ехаmple․com")]),
    ("b​ob@exam‍ple.com", [("email", "bob@example.com", "b​ob@exam‍ple.com")]),
    ("call five five five, one two three, four five six seven ok", [("phone", "5551234567", "five five five, one two three, four five six seven")]),
    ("call (212) 555-0187 or +1 212-555-0187.", [("phone", "2125550187", "(212) 555-0187"), ("phone", "+12125550187", "+1 212-555-0187")]),
    ("card 4111 1111 1111 1111, not 4111 1111 1111 1112", [("card", "4111111111111111", "4111 1111 1111 1111")]),
    ("ssn 123-45-6789 ip 192.168.0.1 not 999.1.1.1 or 1.2.3.4.5", [("ssn", "123-45-6789", "123-45-6789"), ("ip", "192.168.0.1", "192.168.0.1")]),
    ("DE89 3704 0044 0532 0130 00", [("iban", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00")]),
    ("１２３-４５-６７８９", [("ssn", "123-45-6789", "１２３-４５-６７８９")]),
    ("we meet at noon dot the one two three", []),
    ("version 1.2.3 of 2024-01-02, 12345 things", []),
    ("", []),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_identifiers(text, expected):
    assert [(k, v, text[a:b]) for k, a, b, v in pii.detect(text)] == expected


@pytest.mark.parametrize("surface, value", [
    ("jane [at] example dot com", "jane@example.com"), ("jane@example dot com", "jane@example.com"), ("jane at example [dot] com", "jane@example.com"),
    ("jane dot doe (at) mail.example dot com", "jane.doe@mail.example.com"), ("jane  at\texample \n dot com", "jane@example.com"), ("jane @ example  dot com", "jane@example.com"),
    ("giulia [at] azienda dot it", "giulia@azienda.it"), ("giulia at azienda dot it", "giulia@azienda.it"), ("raj at site dot co dot in", "raj@site.co.in"),
    ("bob_at_example_dot_com", "bob@example.com"), ("bob-smith-at-mail-dot-example-dot-com", "bob-smith@mail.example.com"), ("bob.x_at_my_host_dot_co_dot_uk", None),
    ("raj@site dot co dot in", "raj@site.co.in"), ("ana at firma [dot] museum", "ana@firma.museum"), ("jane @example dot com", "jane@example.com"),
])
def test_mixed_disguises(surface, value):
    for before, after in (("", ""), ("mail: ", ", please"), ("(", ") or call")):
        text = before + surface + after
        assert [(k, v, text[a:b]) for k, a, b, v in pii.detect(text)] == ([("email", value, surface)] if value else [])


@pytest.mark.parametrize("surface, kind, value", [
    ("five five five - one two three - four five six seven", "phone", "5551234567"), ("five five five\n one two three\nfour five six seven", "phone", "5551234567"),
    ("five five five 123 4567", "phone", "5551234567"), ("555 one two three 4567", "phone", "5551234567"), ("five five five 1234567", "phone", "5551234567"), ("five-five-five one-two-three four-five-six-seven", "phone", "5551234567"),
    ("+1 five five five one two three four five six seven", "phone", "+15551234567"),
    ("one two three - four five - six seven eight nine", "ssn", "123-45-6789"), ("123-four five-6789", "ssn", "123-45-6789"), ("one two three dash four five dash six seven eight nine", "ssn", "123-45-6789"),
    ("one nine two dot one six eight dot zero dot one", "ip", "192.168.0.1"), ("192 dot 168 dot zero dot 1", "ip", "192.168.0.1"),
    ("four one one one - 1111 - 1111 - one one one one", "card", "4111111111111111"),
    ("five 5 five 1 2 three 4 five 6 seven", "phone", "5551234567"), ("double five five one two three four five six seven", "phone", "5551234567"), ("triple five one two three four five double six", "phone", "5551234566"),
])
def test_mixed_digits(surface, kind, value):
    for before, after in (("", ""), ("it is ", ", ok"), ("one. It is (", ") or two")):
        text = before + surface + after
        assert [(k, v, text[a:b]) for k, a, b, v in pii.detect(text)] == [(kind, value, surface)]


@pytest.mark.parametrize("text", ["One. Two. Three. Four.", "one of 2024-01-02, 12345 things", "section two 2019 12345", "one two three dot four", "room one, 1 to 3 and 4 5 6"])
def test_prose_is_no_number(text):
    assert pii.detect(text) == []


@pytest.mark.parametrize("text", ["look at the dot in the middle", "look at the dot.", "stare at polka dot dresses", "see it at example.com", "thanks @bob.smith", "thanks @bob dot matrix", "he looked at a red dot on it"])
def test_prose_is_no_address(text):
    assert pii.detect(text) == []


@pytest.mark.parametrize("text", [
    " " * 500_000 + "[at] x", "a dot " * 150_000, "a@b.co " * 100_000, "one " * 150_000, "a at " * 150_000, "x@" + "a." * 300_000, "[ " * 300_000, "1-" * 300_000, "a_at_" * 100_000, "a" * 600_000 + "@", "one dot " * 80_000,
    "x " + " " * 300_000 + "at" + " " * 300_000 + "y dot", "five " * 4 + "(" * 300_000, "double " * 80_000, "DE12 " + "AB34 " * 100_000, "+1 23 " * 100_000,
])
def test_long_texts_take_time_in_proportion(text):
    times = []
    for part in (text[: len(text) // 4], text):
        began = time.process_time()
        pii.detect(part)
        times.append(time.process_time() - began)
    assert times[1] < 12 * max(times[0], 0.05)


def _disguised(rng, plain):
    """The plain identifier behind disguises, made one character at a time."""
    glyphs = {"a": "а", "e": "е", "o": "о", "c": "с", "p": "р", "@": "＠", ".": "．", "1": "１", "7": "７"}
    out, spelled = [], rng.random() < 0.3 and plain.replace("-", "").isdigit()
    words = "zero one two three four five six seven eight nine".split()
    if spelled:
        return (" - " if "-" in plain else " ").join(" ".join(words[int(c)] for c in part) for part in plain.split("-"))
    for k, c in enumerate(plain):
        if c == "@" and rng.random() < 0.5:
            out.append(rng.choice([" [at] ", "(at)", " {@} "]))
        elif c == "." and "@" in plain and rng.random() < 0.5:
            out.append(rng.choice([" [dot] ", "(dot)", " (.) "]))
        elif c in glyphs and rng.random() < 0.3:
            out.append(glyphs[c])
        else:
            out.append(c)
        if 0 < k < len(plain) - 1 and plain[k - 1].isalnum() and rng.random() < 0.1:
            out.append("\u200b")
    return "".join(out).strip("\u200b")


def test_planted_identifiers_come_back():
    """Texts made of prose and disguised identifiers: exactly those are found, with their places and values."""
    rng = random.Random(12)
    kinds = {"email": ["bob@example.com", "ann.lee@mail.example.org", "x9@a-b.co"], "phone": ["555-123-4567", "212-867-5309"], "ssn": ["123-45-6789", "777-12-3456"], "ip": ["192.168.0.1", "10.20.30.40"], "card": ["4111111111111111"]}
    for _ in range(400):
        text, want = "", []
        for _ in range(rng.randint(1, 5)):
            text += " ".join(rng.choices(["the", "house", "стоит", "was", "green", "über"], k=rng.randint(1, 6))) + rng.choice([": ", " is (", "; "])
            kind = rng.choice(list(kinds))
            plain = rng.choice(kinds[kind])
            surface = _disguised(rng, plain) if kind != "ip" else plain
            want.append((kind, len(text), len(text) + len(surface), plain.replace("-", "") if kind == "phone" else plain))
            text += surface + rng.choice([", ", "; ", ") "])
        assert pii.detect(text) == want, text


def test_identifiers_of_a_table(spark, docs, none):
    long = "word " * 100_000 + "end: a@b.co"
    df = spark.createDataFrame([(1, t, "x") for t, _ in CASES] + [(None, "a@b.co", None), (2, None, "x"), (3, long, "x"), (3, long, "x")], "doc_id bigint, text string, value string")
    out = pii.find_private(df).collect()
    want = sorted((k, v, s) for _, e in CASES for k, v, s in e) + [("email", "a@b.co", "a@b.co")] * 3
    assert sorted((r.kind, r.value, r.surface) for r in out) == sorted(want)
    assert [(r.start, r.end) for r in out if r.doc_id == 3] == [(len(long) - 6, len(long))] * 2
    assert pii.find_private(docs).where("kind IS NULL OR end <= start").count() == 0 and pii.find_private(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["bob", " at ", "[at]", " dot ", "com", "five ", "nine-", "@", ".", "ex", "​", "＠", "о", "555", " "]), max_size=14).map("".join))
def test_offsets_stay_inside(text):
    marks = [(a, b) for _, a, b, _ in pii.detect(text)]
    assert all(0 <= a < b <= len(text) for a, b in marks) and all(b <= c for (_, b), (c, _) in zip(marks, marks[1:]))
    plain = pii.normalised(text)
    places = [plain.source(k, k + 1) for k in range(len(plain.plain))]
    assert all(a < b for a, b in places) and places == sorted(places)


# compression

def test_compression(docs, rows, none):
    out = compression.judge(docs)
    compress = zstandard.ZstdCompressor(level=3).compress
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.ratio or 0, r.n_chunks, r.keep, r.reason or "") for r in out.collect())
    want = []
    for d, t, *_ in rows:
        data = (t or "").encode()
        ratio = round(len(compress(data)) / len(data), 6) if data else None
        chunks, least, most = [], 0, 2
        for size, n, *limits in compression.CHUNKS:
            if len(data) >= size:
                least, most = limits
                ends = {min(k + n, len(data)) for k in range(0, len(data), n)}
                chunks = [len(compress(data[e - n : e])) / n for e in ends]
        band = [b for b in compression.BANDS if b[0] <= len(data)][-1:]
        reason = ""
        for _, low, high in band:
            share = lambda f: sum(map(f, chunks)) > compression.OUTSIDE * len(chunks)
            reason = "repetitive" if ratio < low else "incompressible" if ratio > high else "repetitive chunks" if share(lambda c: c < least) else "incompressible chunks" if share(lambda c: c > most) else ""
        want.append((d is None, d or 0, len(data), ratio or 0, len(chunks), not reason, reason))
    assert got == sorted(want) and any(w[6] for w in want)
    assert compression.judge(none).count() == 0


@pytest.mark.parametrize("prose, junk", [(1200, 1200), (4096, 3900), (40_000, 16_000)])
def test_junk_is_found_wherever_it_stands(prose, junk):
    compress, rng = zstandard.ZstdCompressor(level=3).compress, random.Random(7)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(prose))[:prose]
    line = ("buy now cheap " * junk)[:junk]
    assert compression.verdict(text, compress)[5] is None
    for whole in (line + text, text + line, text[: prose // 2] + line + text[prose // 2 :]):
        assert compression.verdict(whole, compress)[5] in ("repetitive", "repetitive chunks")


# packing

@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(5, 20))
def test_best_fit(lengths, capacity):
    pieces = [p for n in lengths for p in [capacity] * (n // capacity) + [n % capacity] if p]
    counts = {n: pieces.count(n) for n in pieces}
    filled = {}
    for length, a, b, first, each in packing.plan_bins(counts, capacity):
        for k in range(b - a):
            at = first + k // each
            filled[at] = filled.get(at, 0) + length
    assert sorted(capacity - x for x in filled.values()) == brute.bins(lengths, capacity)


def test_tightest():
    tree = packing.CapacityTree(10)
    assert tree.tightest(0) is None
    for r in (3, 7, 7, 10):
        tree.add(r, 1)
    assert [tree.tightest(k) for k in range(12)] == [3] * 4 + [7] * 4 + [10] * 3 + [None]


def test_packing(docs, rows, none):
    out = packing.pack_documents(docs, 100).collect()
    lengths = [brute.count(r[1]) for r in rows]
    room = {}
    for r in out:
        room[r.bin_id] = room.get(r.bin_id, 100) - r.n_tokens
    assert sorted(room.values()) == brute.bins(lengths, 100)
    assert sorted(room) == list(range(len(room)))
    pieces = sorted((r.doc_id is None, r.doc_id or 0, r.start_token, r.n_tokens) for r in out)
    assert pieces == sorted((r[0] is None, r[0] or 0, a, min(100, n - a)) for r, n in zip(rows, lengths) for a in range(0, n, 100))
    assert packing.pack_documents(none).count() == 0


def test_bins_do_not_depend_on_the_session(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 40)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for number in ("3", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", number)
            found.append(sorted(map(str, packing.pack_documents(docs, 100).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_best_fit_of_whole_bins():
    rng = random.Random(11)
    lengths = [rng.choice([rng.randint(1, 60), rng.randint(1, 3000), 2048, 1024]) for _ in range(4000)]
    pieces = [p for n in lengths for p in [packing.CAPACITY] * (n // packing.CAPACITY) + [n % packing.CAPACITY] if p]
    filled = {}
    for length, a, b, first, each in packing.plan_bins({n: pieces.count(n) for n in set(pieces)}, packing.CAPACITY):
        for k in range(b - a):
            filled[first + k // each] = filled.get(first + k // each, 0) + length
    assert sorted(packing.CAPACITY - x for x in filled.values()) == brute.bins(lengths, packing.CAPACITY)


# mixing

def test_mixing(docs, rows, none):
    out = mixing.mix_sources(docs).collect()
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    assert sorted((tuple(r) for r in out), key=key) == sorted(brute.copies([(r[0], r[1], r[3]) for r in rows]), key=key)
    assert mixing.mix_sources(none).count() == 0


def test_targets_are_met(spark):
    rng = random.Random(6)
    rows = [(k, "t " * rng.randint(1, 50), rng.choice("abc"), rng.choice(["en", "de", None])) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    rates = mixing.mix_sources(df, weights={"a": 3, "b": 1}, balance={"lang": None}).join(df.select("doc_id", "lang"), "doc_id")
    by = {r.source: r.t for r in rates.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("rate")).alias("t")).collect()}
    total = sum(brute.count(r[1]) for r in rows)
    assert by["a"] == pytest.approx(total * 0.75, rel=1e-4) and by["b"] == pytest.approx(total * 0.25, rel=1e-4) and by["c"] == 0
    langs = {r.lang: r.t for r in rates.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("rate")).alias("t")).collect()}
    own = {v: sum(brute.count(r[1]) for r in rows if r[3] == v) for v in langs}
    roots = sum(math.sqrt(t) for t in own.values())
    assert all(langs[v] == pytest.approx(total * math.sqrt(own[v]) / roots, rel=1e-4) for v in langs)
    drawn = rates.agg(F.sum(F.col("copies") * F.col("n_tokens"))).first()[0]
    assert drawn == pytest.approx(total, rel=0.05)
    with pytest.raises(ValueError):
        mixing.mix_sources(df, weights={"z": 1})


def test_balanced_columns_of_any_name(spark):
    rows = [(k, "t " * (1 + k % 5), f"s{k % 3}", k % 2, k % 7 == 0) for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, tokens int, `a.b` boolean").withColumns({"rate": F.col("tokens"), "n_tokens": F.lit("x"), "copies": F.lit(1)})
    plain = df.select("doc_id", "text", "source", F.col("tokens").alias("x"), F.col("`a.b`").alias("y"))
    got = mixing.mix_sources(df, balance={"tokens": None, "a.b": {True: 1, False: 3}}).collect()
    want = mixing.mix_sources(plain, balance={"x": None, "y": {True: 1, False: 3}}).collect()
    assert sorted(got) == sorted(want) and len(got) == 400
    assert mixing.mix_sources(df, balance={"rate": None, "n_tokens": None}).count() == 400


def test_constraints_that_contradict_each_other(spark):
    rows = [(k, "t", "ab"[k % 2], "ab"[k % 2]) for k in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    with pytest.warns(RuntimeWarning):
        assert mixing.mix_sources(df, weights={"a": 3, "b": 1}, balance={"lang": {"a": 1, "b": 3}}).where("rate > 0").count() == 20


def test_any_number_of_sources(spark):
    rows = [(k, "t " * (1 + k % 7), f"s{k % 4500}") for k in range(6000)] + [(6000 + k, None if k % 2 else "", f"z{k}") for k in range(500)] + [(7000, "t", None)]
    key = lambda x: tuple((v is not None, v or 0) for v in x)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = mixing.mix_sources(df).collect()
    assert sorted((tuple(r) for r in out), key=key) == sorted(brute.copies(rows), key=key)
    tokens = sum(brute.count(t) for _, t, _ in rows)
    given = {r.source: r.n_tokens * r.rate for r in mixing.mix_sources(df, weights={"s4400": 3, None: 1, "z3": 5, "none": 2}).where("n_tokens > 0 AND rate > 0").collect()}
    assert given == pytest.approx({"s4400": tokens * 0.75, None: tokens * 0.25}, rel=1e-6)


def test_many_constraints_on_two_columns(spark):
    rng = random.Random(8)
    rows = [(k, "t " * rng.randint(1, 9), f"s{k % 4100}", rng.choice(["en", "de", "fr", None])) for k in range(16_400)] + [(20_000 + k, "", f"z{k}", "en") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    cells = df.groupBy("source", "lang").agg(F.sum(mixing.token_count("text")).alias("tokens"))
    solved = [(r.source, r.lang, r.tokens * r.rate) for r in mixing.solve_rates(cells, ["source", "lang"], [None, {"en": 2, "de": 1, "fr": 1, None: 1}]).join(cells.withColumnsRenamed({"source": "s", "lang": "l"}), F.expr("source <=> s AND lang <=> l")).collect()]
    total, by, own = sum(brute.count(r[1]) for r in rows), {}, {}
    for source, lang, x in solved:
        by[source], by["in", lang] = by.get(source, 0) + x, by.get(("in", lang), 0) + x
    for _, text, source, _ in rows:
        own[source] = own.get(source, 0) + brute.count(text)
    roots = sum(map(math.sqrt, own.values()))
    assert [by["in", v] for v in ("en", "de", "fr", None)] == pytest.approx([total * w / 5 for w in (2, 1, 1, 1)], rel=1e-6)
    assert all(by[v] == pytest.approx(total * math.sqrt(t) / roots, rel=1e-6) for v, t in own.items())


# search

@pytest.mark.parametrize("block", [4096, 50])
def test_nearest(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 24))
    x = np.round(centres[rng.integers(0, 8, 300)] + rng.normal(scale=0.3, size=(300, 24)), 2)
    x[10], x[20], x[21] = x[11], x[11], x[11]
    ids = rng.permutation(300)
    rows = [(int(i), [float(v) for v in r], 1) for i, r in zip(ids, x)]
    rows += [rows[0], (None, [0.0] * 24, 1), (900, None, 1), (901, [], 1), (902, [float("nan")] * 24, 1), (903, [1.0] * 5, 1), (904, [None] * 24, None)]
    out = topk.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int"), k=7, block_size=block).collect()
    got = {(r.vec_id, r["rank"]): (r.neighbor_id, r.distance) for r in out}
    want = {}
    for i, r in zip(ids, x):
        d = sorted((float(np.sqrt(((r - y) ** 2).sum())), int(j)) for j, y in zip(ids, x) if j != i)
        want |= {(int(i), n + 1): (j, dist) for n, (dist, j) in enumerate(d[:7])}
    assert len(out) == len(got) and {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] == pytest.approx(want[k][1], rel=1e-9) for k, v in got.items())


def test_nearest_of_some(spark, monkeypatch):
    monkeypatch.setattr(topk, "PACK", 5)
    monkeypatch.setattr(topk, "PIVOTS", 7)
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(10, 32))[rng.integers(0, 10, 400)] * 3 + rng.normal(size=(400, 32)), 2).astype(np.float32)
    df = spark.createDataFrame([(k, [float(v) for v in r], "q" if k % 9 == 0 else None) for k, r in enumerate(x)], "vec_id bigint, embedding array<float>, cell string")
    got = sorted((r.vec_id, r["rank"], r.neighbor_id) for r in topk.nearest(df, 4, 40, F.col("cell") == "q").collect())
    want = []
    for k in range(0, 400, 9):
        d = np.sqrt(((x.astype(float) - x[k].astype(float)) ** 2).sum(1))
        want += [(k, n + 1, int(j)) for n, j in enumerate([j for j in np.lexsort((np.arange(400), d)) if j != k][:4])]
    assert got == want


def test_coarse_levels_discard_most_pairs_of_clusters():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 64))[rng.integers(0, 40, 6000)] + rng.normal(scale=0.1, size=(6000, 64))
    ids, at = np.arange(len(x)), np.arange(0, len(x), 30)
    left: list[int] = []
    bounds = topk.own_bounds(ids, x, at, 10)
    i, n, d = topk.search(ids[at], x[at], bounds, ids, x, 10, left)
    pairs = len(at) * len(x)
    assert len(left) == 4 and left == sorted(left, reverse=True)
    assert left[0] < 0.3 * pairs and left[2] < 0.06 * pairs and left[3] < 0.01 * pairs
    assert len(i) == 10 * len(at)
    # and whole blocks are never seen
    by_cluster = np.argsort(((x[:, None] - x[None, at[:40]]) ** 2).sum(2).argmin(1), kind="stable")
    y = x[by_cluster]
    low, high = (np.array([f(topk.statistics(y[a : a + 150], 16), axis=0) for a in range(0, 6000, 150)]) for f in (np.min, np.max))
    seen = topk.box_bounds(topk.statistics(x[at], 16), low, high) <= bounds[:, None]
    assert seen.mean() < 0.5


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_boxes_bound_the_distance(seed):
    x = np.random.default_rng(seed).normal(size=(30, 40))
    s = topk.statistics(x, 8)
    bound = topk.box_bounds(s, s[10:].min(0)[None], s[10:].max(0)[None])[:, 0]
    assert (bound <= np.sqrt(((x[:, None] - x[None, 10:]) ** 2).sum(2)).min(1) + 1e-9).all()


def test_nearest_of_few(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk.nearest(spark.createDataFrame([], schema)).count() == 0
    out = topk.nearest(spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 3.0]), (3, [0.0, 3.0])], schema)).collect()
    assert sorted((r.vec_id, r["rank"], r.neighbor_id) for r in out) == [(1, 1, 2), (1, 2, 3), (2, 1, 3), (2, 2, 1), (3, 1, 2), (3, 2, 1)]


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 40), st.integers(0, 10**6))
def test_segment_statistics_bound_the_distance(dimension, seed):
    x = np.random.default_rng(seed).normal(size=(6, dimension))
    exact = ((x[:, None] - x[None]) ** 2).sum(2)
    for level in topk.LEVELS:
        s = topk.statistics(x, level)
        assert (((s[:, None] - s[None]) ** 2).sum(2) <= exact + 1e-9).all()


# the archive

def _stored(store):
    return sorted(bytes(r.payload) for r in store.payloads.select("payload").collect())


def test_archive(spark):
    pages = [(1, "http://a/", "<p>x</p>"), (2, "http://b/", "<p>x</p>"), (3, None, "<p>x</p>"), (4, "http://d/", None), (5, "http://e/", ""), (1, "http://a/", "<p>x</p>"), (None, "http://f/", "é" * 200_000)]
    records = warc.page_records(spark.createDataFrame(pages, "page_id bigint, url string, html string"))
    store = warc.archive(records)
    assert store.payloads.count() == 3 and store.headers.count() == 7
    want = sorted(bytes(r.header) + bytes(r.payload or b"") + b"\r\n\r\n" for r in records.collect())
    for hot in (warc.HOT, 1):  # with 1, the payload of four records is copied for several tasks
        back = warc.reconstruct(store, hot).collect()
        assert all(r.exact for r in back) and len(back) == 7
        assert sorted(bytes(r.record) for r in back) == want
    empty = warc.archive(records.limit(0))
    assert warc.reconstruct(empty).count() == 0
    bad = warc.archive(records.limit(1).withColumn("header", F.lit(None).cast("binary")))
    assert [(r.record, r.exact) for r in warc.reconstruct(bad).collect()] == [(None, False)]


def test_archive_is_added_to(spark, tmp_path):
    path = str(tmp_path / "an 'archive' of.mine")
    rows = [(k, f"h{k}".encode(), f"p{k % 3}".encode()) for k in range(6)]
    schema = "id int, header binary, payload binary"
    warc.archive(spark.createDataFrame(rows, schema), path)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")  # as another session might
        store = warc.Archive(spark, path)
        store.append(spark.createDataFrame(rows, schema))
        store.append(spark.createDataFrame([(9, b"h9", b"new"), (10, b"h10", None), (11, b"h11", b"p0")], schema))
        assert _stored(store) == [b"new", b"p0", b"p1", b"p2"]
        back = warc.reconstruct(warc.Archive(spark, path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(r.exact for r in back) and sorted(r.id for r in back) == sorted([*range(6)] * 2 + [9, 10, 11])


def test_key_columns_of_any_name(spark):
    names = ["digest", "record_digest", "n_bytes", "record", "exact", "key", "a.b", "mark", "__n"]
    df = spark.createDataFrame([(b"h", b"p"), (b"i", b"p")], "header binary, payload binary").withColumns({n: F.lit(n) for n in names})
    back = warc.reconstruct(warc.archive(df))
    assert back.columns == [*names, "digest_", "n_bytes_", "record_", "record_digest_", "exact_"]
    assert all(r["exact_"] and r["n_bytes_"] == 1 and all(r[n] == n for n in names) for r in back.collect())
    assert warc.reconstruct(warc.archive(df.select("header", "payload"))).columns == ["digest", "n_bytes", "record", "record_digest", "exact"]


def test_files(spark, tmp_path):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    page = b"WARC/1.0\r\ncontent-type: application/http; msgtype=response\r\nContent-Length: 30\r\n\r\nHTTP/1.1 200 OK\r\nA: b\r\n\r\n\r\n\r\nx\r\n\r\n"
    bad = b"WARC/1.0\r\nContent-Length: 1e2\r\n\r\nsome bytes\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(info + page + info[:-6])
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(info) + gzip.compress(page))
    (tmp_path / "c.warc").write_bytes(b"")
    (tmp_path / "d.warc").write_bytes(info + bad + page)
    records = warc.read_warc(spark, str(tmp_path))
    rows = records.collect()
    assert len(rows) == 7 and {bytes(r.payload) for r in rows if r.payload is not None} == {b"hello", b"\r\n\r\nx"}
    assert [bytes(r.header) for r in rows if r.error] == [bad[:-4]]
    whole = sorted(bytes(r.record) for r in warc.reconstruct(warc.archive(records)).collect())
    assert whole == sorted([info, page] * 3 + [bad])


def test_cut_off_members():
    records = [b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % n + random.Random(n).randbytes(n) + b"\r\n\r\n" for n in (5, 200_000, 7, 90_000)]
    whole = b"".join(map(gzip.compress, records))
    for cut in (1, 9, 40_000):
        got = warc.gunzipped(whole[:-cut])
        assert b"".join(records).startswith(got) and len(list(warc.split_records(got))) >= 3 and len(got) > len(b"".join(records)) - cut - 200
    for after in (b"junk", b"\0" * 20, b"\x1f", b""):
        assert warc.gunzipped(whole + after) == b"".join(records)
    with pytest.raises(zlib.error):
        warc.gunzipped(whole[:-8] + b"\1" * 8)
