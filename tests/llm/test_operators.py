"""Each operator against brute force or a round trip, and on nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import html
import random
import re
import time
import zlib
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relkit.llm import decontaminate, flac, html_wrapper, langid, line_dedup, media, omh_dedup, pii, sentencepiece_scan, substring_dedup, warc
from relkit.llm._text import ALNUM, LOWER, NONSPACE, Words, gather, slices, sliding_min
from relkit.llm.components import components

FOLDER = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGES = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "s", 5), (1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", None, "s", 5), (4, LONG, "en", "s", 1), (5, "!!! ???", "en", "s", 7), (6, "\n\n \n", "de", "s", 3)]
#: Names that the operators use themselves.
CLASHES = ["row", "doc", "id", "kept", "mentions", "known", "copies", "ids", "__hits", "__n_words", "gone", "key"]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA)


@pytest.fixture(scope="module")
def clashing(edges):
    return edges.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- windows of words -----------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB9é ,.\n\t日", max_size=30)), max_size=8), st.integers(1, 4))
def test_words_are_those_of_the_pattern(texts, k):
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
    for table, pattern in ((ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (NONSPACE, r"[^\x20\x09-\x0D]+")):
        found, hashes = [], {}
        for lo, hi, off, raw in slices(batch, "text", 40):
            w = Words(off, LOWER[raw] if table is ALNUM else raw, table)
            for i in range(hi - lo):
                own = [w.data[a:b].tobytes().decode() for a, b in zip(w.starts[w.first[i] : w.first[i + 1]], w.ends[w.first[i] : w.first[i + 1]])]
                found.append(own)
                hashes.update(zip(own, w.hashes[w.first[i] : w.first[i + 1]].tolist()))
            got, whole = w.windows(k)
            assert len(got) == max(0, len(w) - k + 1) and all((w.text[p] == w.text[p + k - 1]) == whole[p] for p in range(len(got)))
        lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "") if table is ALNUM else t or ""
        assert found == [re.findall(pattern, lower(t)) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


def signs(n, a, b):
    """The Thue-Morse word: hashes that are polynomials of the letters modulo a power of two take it for its inverse."""
    return "".join(b if i.bit_count() & 1 else a for i in range(n))


SIGNS = [(signs(n, "a", "b"), signs(n, "b", "a")) for n in (1024, 2048, 4096)]


@pytest.mark.parametrize("pair", SIGNS)
def test_hashes_of_words_without_a_pattern_that_cancels_out(spark, vocabulary, pair):
    raw = np.frombuffer(" ".join(pair).encode(), np.uint8)
    words = Words(np.array([0, len(raw)]), raw, NONSPACE)
    assert words.hashes[0] != words.hashes[1] and words.joined() == [" ".join(pair).encode()]
    filler = [f"w{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join([x, *filler])) for i, x in enumerate(pair)], "doc_id bigint, text string")
    assert {r.n_removed for r in substring_dedup.dedup(docs).collect()} == {0}
    assert {r.doc_id: r.rep_id for r in omh_dedup.classes(docs).collect()} == {0: 0, 1: 1}
    out = by_id(sentencepiece_scan.decode(sentencepiece_scan.encode(docs)))
    assert all(out[i].decoded == " ".join([x, *filler]) for i, x in enumerate(pair))


def test_segments_of_one_hash_are_told_apart(monkeypatch):
    monkeypatch.setattr(sentencepiece_scan, "range_hashes", lambda data, a, b: np.zeros(len(a), np.uint64))
    one, same = sentencepiece_scan._distinct(np.frombuffer(b"abcabdab", np.uint8), np.array([0, 3, 6]), np.array([3, 3, 2]))
    assert len(one) == 3 and len(set(same)) == 3


def test_arrays():
    assert gather(np.array([5, 0, 9]), np.array([2, 0, 3])).tolist() == [5, 6, 9, 10, 11]
    assert sliding_min(np.array([4, 2, 5, 1, 3]), 3).tolist() == [2, 1, 1]


# --- 1 language ID ----------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    docs = documents(spark)
    found = langid.query(spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95
    assert found.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(found.doc_id, found.held_out))


def test_language_edges(spark, edges, clashing):
    model = langid.fit(documents(spark))
    got = langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "这是一个测试的句子"), (5, "the of and to in is that")], "doc bigint, text string"), model).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in got[:3]] == [("und", 0.0, True)] * 3
    assert got[3].rejected and not got[4].rejected and got[4].lang_pred == "en"
    assert langid.fit(empty(spark)) is None and langid.fit(edges.withColumn("lang", F.lit(None).cast("string"))) is None
    assert langid.predict(edges.select(F.col("doc_id").alias("doc"), "text"), None).where("lang_pred = 'und' and rejected").count() == len(EDGES)
    kept = langid.keep(clashing, model)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.collect()} <= {1, None, 4}
    assert langid.keep(empty(spark), model).count() == 0


def test_language_rejects_what_is_far_from_all_languages(spark):
    model, r = langid.fit(documents(spark)), random.Random(4)
    letters = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    junk = [letters("abcdefghijklmnopqrstuvwxyz ", n) for n in (100, 300, 3000)] + [letters("0123456789abcdef", n) for n in (300, 3000)] + [letters("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", n) for n in (200, 3000)]
    junk += ["x" * 400, "qwer tzui asdf ghjk " * 20]
    # a language that was not learnt, in the letters of those that were
    junk += ["Litwo ojczyzno moja ty jestes jak zdrowie ile cie trzeba cenic ten tylko sie dowie kto cie stracil dzis pieknosc twa w calej ozdobie widze i opisuje bo tesknie po tobie " * 3]
    got = langid.predict(spark.createDataFrame(list(enumerate(junk)), "doc bigint, text string"), model).collect()
    assert all(x.rejected for x in got), [(x.doc, x.score) for x in got if not x.rejected]
    clean = documents(spark).where("length(text) > 20")
    assert langid.keep(clean, model).count() >= 0.99 * clean.count()


def test_language_sample_is_bounded_on_repeats(spark):
    """Rows of one doc_id, and rows of one text, are no single unit that comes in whole."""
    rows = [(1, f"{x} der die das und", "de") for x in range(3000)] + [(i, "the of and to in is that", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, per_lang=100)
    assert set(model["langs"]) <= {"de", "en"} and "de" in model["langs"]


# --- 2 decontamination --------------------------------------------------------------


def brute_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    own, hit, ids = words(text), set(), set()
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for p in range(len(w) - k + 1 if k else 0):
            for at in range(len(own) - k + 1):
                if own[at : at + k] == w[p : p + k]:
                    hit.update(range(at, at + k))
                    ids.add(str(i))
    return len(own), len(hit), sorted(ids)


def test_decontaminate(spark, edges, clashing):
    items = [(7, "Seven, EIGHT nine"), (7, "seven eight nine"), (10, "two three four five six seven eight nine ten eleven twelve zzz"), (11, None), (12, "!!"), (None, "w5 w6 w7")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (16 << 20, 100):
        for r in decontaminate.report(clashing, bench, block_bytes=block).collect():
            text = next(t for i, t, *_ in EDGES if i == r.doc_id)
            n, hit, ids = brute_hits(text[:400] if text and len(text) > 1000 else text, [(i, t) for i, t in items if i])
            if text is not LONG:
                assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(ids), hit > 0)
                assert r.items_sha256 == hashlib.sha256(",".join(ids).encode()).hexdigest()
            else:
                assert r.contaminated and r.n_items == 0 and r.n_words == 60_000
    assert decontaminate.clean(clashing, bench).columns == clashing.columns
    assert {r.doc_id for r in decontaminate.clean(clashing, bench).collect()} == {2, 3, 5, 6}
    spans = by_id(decontaminate.clean(edges.where("doc_id = 1"), bench, remove="spans"))
    assert spans[1].text == "one  thirteen fourteen"
    assert decontaminate.clean(empty(spark), bench).count() == 0 and decontaminate.clean(edges, bench.limit(0)).count() == len(EDGES)


# --- 3 line dedup ---------------------------------------------------------------------


def brute_lines(docs, n):
    seen, out = set(), {}
    for i, text in sorted(docs):
        lines = text.split("\n")
        own = [j for j, x in enumerate(lines) if x.strip(" ")]
        gone = set()
        for p in range(len(own) - n + 1):
            run = tuple(lines[j] for j in own[p : p + n])
            if run in seen:
                gone.update(own[p : p + n])
            seen.add(run)
        out[i] = "\n".join(x for j, x in enumerate(lines) if j not in gone)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_line_dedup(spark, n):
    r = random.Random(n)
    docs = [(i, "\n".join(r.choice(["a", "b", "c", "", "d d"]) for _ in range(r.randint(0, 12)))) for i in range(40)]
    found = line_dedup.cut(spark.createDataFrame(docs, "doc_id bigint, text string"), min_lines=n)
    assert {x.row.doc_id: x.kept for x in found.collect()} == brute_lines(docs, n)


def brute_runs(docs):
    """The maximal runs that occur earlier, by comparing every pair of suffixes."""
    seqs = {i: [x for x in t.split("\n") if x.strip(" ")] for i, t in docs}
    places = sorted((i, p) for i, s in seqs.items() for p in range(len(s)))
    out, reach = set(), {}
    for at, (i, p) in enumerate(places):
        best = (0, None)
        for j, q in places[:at]:
            n = 0
            while p + n < len(seqs[i]) and q + n < len(seqs[j]) and seqs[i][p + n] == seqs[j][q + n]:
                n += 1
            best = max(best, (n, (-j, -q))) if n else best
        if best[0] and p + best[0] > reach.get(i, 0):
            out.add((i, p, best[0], -best[1][0], -best[1][1]))
            reach[i] = p + best[0]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_maximal_runs_are_those_of_all_pairs_of_suffixes(spark, seed):
    r = random.Random(seed)
    docs = [(i, "\n".join(r.choice("abc") for _ in range(r.randint(0, 14)))) for i in range(14)]
    long = [r.choice("defgh") for _ in range(37)]
    docs += [(20, "\n".join(long)), (21, "\n".join(["x", *long[5:30], "y"])), (22, "\n".join(long[:9] + long[:9])), (23, "\n".join(long[3:36]))]
    found = line_dedup.runs(spark.createDataFrame(docs, "doc bigint, text string")).collect()
    assert {(x.doc, x.pos, x.length, *x.first) for x in found} == brute_runs(docs)


def test_long_lines_are_cut_alone(spark):
    words = " ".join(f"w{i}" for i in range(line_dedup.MIN_WORDS))
    docs = spark.createDataFrame([(1, f"{words}\nshort"), (2, f"a\n{words}\nb\nshort\nc"), (3, words), (4, words[:-4])], "doc_id bigint, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup(docs).collect()} == {1: f"{words}\nshort", 2: "a\nb\nshort\nc", 4: words[:-4]}


def test_line_dedup_edges(spark, clashing):
    more = clashing.union(clashing.where("doc_id = 4").withColumn("doc_id", F.lit(9).cast("bigint")))
    out = line_dedup.dedup(more, min_lines=1)
    assert out.columns == clashing.columns
    # the second long text goes, the repeated row and the null doc_id stay
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["1", "1", "2", "3", "None", "4", "5", "6"])
    assert line_dedup.dedup(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.cut(clashing, min_lines=0)


# --- 4 FLAC ----------------------------------------------------------------------------


def test_media_round_trip(spark, clashing):
    stored = media.store(clashing)
    for r in media.digest(stored).collect():
        raw = next(t for i, t, *_ in EDGES if i == r.doc_id)
        raw = (raw or "").encode()
        payload = raw + b"\xff" * (max(576, -(-len(raw) // 576) * 576) - len(raw))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    blocks = media.blocks(stored.where("doc_id = 4"), samples_per_block=1000).orderBy("sample_offset").collect()
    assert [b.sample_offset for b in blocks] == list(range(0, 1000 * len(blocks), 1000))
    pcm = np.frombuffer(b"".join(b.pcm for b in blocks), np.int8).astype(int) + 128
    assert bytes(pcm.astype(np.uint8)).rstrip(b"\xff") == LONG.encode()
    one = stored.where("doc_id = 1").select("media").distinct()
    assert one.count() == 1  # equal texts, equal streams
    nothing = stored.limit(1).withColumn("media", F.lit(None).cast("binary"))
    assert media.blocks(nothing).count() == 0 and media.digest(nothing).first().feature is None
    assert media.digest(media.store(empty(spark))).count() == 0


class BitWriter:
    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [(value >> (width - 1 - j)) & 1 for j in range(width)]

    def bytes(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, self.bits[i : i + 8])), 2) for i in range(0, len(self.bits), 8))


def crc(data, poly, bits):
    c = 0
    for b in data:
        c ^= b << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ poly if c & (1 << (bits - 1)) else c << 1
        c &= (1 << bits) - 1
    return c


@pytest.mark.parametrize("order", range(5))
@pytest.mark.parametrize("escape", [False, True])
def test_flac_reads_frames_it_does_not_write(order, escape):
    """16-bit fixed predictors, wasted bits, 5-bit Rice parameters, escapes and a short last block, without a seek table."""
    r = np.random.default_rng(order)
    samples = (np.cumsum(r.integers(-9, 10, 70)) * 2).tolist()
    coefficients = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
    out = b""
    for number, lo in ((0, 0), (1, 48)):
        own = [x >> 1 for x in samples[lo : lo + 48]]
        w = BitWriter()
        w.put(0xFFF8, 16), w.put(6, 4), w.put(0, 4), w.put(0, 4), w.put(4, 3), w.put(0, 1), w.put(number, 8), w.put(len(own) - 1, 8)
        head = w.bytes()
        w = BitWriter()
        w.put(8 + order, 7), w.put(1, 1), w.put(1, 1)  # one wasted bit
        for x in own[:order]:
            w.put(x & 0x7FFF, 15)
        w.put(1, 2), w.put(0, 4)
        residuals = [own[i] - sum(c * own[i - 1 - j] for j, c in enumerate(coefficients)) for i in range(order, len(own))]
        if escape:
            w.put(31, 5), w.put(16, 5)
            for x in residuals:
                w.put(x & 0xFFFF, 16)
        else:
            w.put(2, 5)
            for x in residuals:
                u = x * 2 if x >= 0 else -2 * x - 1
                w.put(0, u >> 2), w.put(1, 1), w.put(u & 3, 2)
        frame = head + bytes([crc(head, 0x07, 8)]) + w.bytes()
        out += frame + crc(frame, 0x8005, 16).to_bytes(2)
    info = (48).to_bytes(2) * 2 + bytes(6) + (8000 << 44 | 15 << 36 | len(samples)).to_bytes(8) + hashlib.md5(np.array(samples, "<i2").tobytes()).digest()
    stream = b"fLaC\x80" + len(info).to_bytes(3) + info + out
    ((got, x),) = flac.decode([stream])
    assert got["width"] == 16 and x.tolist() == samples
    for at in (-1, -5, len(stream) - len(out) + 4):
        bad = bytearray(stream)
        bad[at] ^= 1
        with pytest.raises(flac.FlacError):
            flac.decode([bytes(bad)])


@settings(max_examples=25, deadline=None)
@given(st.binary(min_size=0, max_size=3000))
def test_flac_any_bytes(raw):
    data = np.frombuffer(raw + bytes(-len(raw) % 576 or (576 if not raw else 0)), np.uint8)
    (info, x), (_, y) = flac.decode(flac.encode([data, data[::-1].copy()]))
    assert ((x + 128).astype(np.uint8) == data).all() and ((y + 128).astype(np.uint8) == data[::-1]).all() and info["samples"] == len(data)


# --- 5 PII -------------------------------------------------------------------------------


def luhn(number):
    d = [int(x) for x in number if x.isdigit()]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0


def test_surrogates(spark, edges):
    said = "Mail ann.lee72@mail3.example.com or ANN.LEE72@MAIL3.EXAMPLE.COM, +1 (569) 555-7279, +1-569-555-7279, 4111 1111 1111 1111 and 4111111111111111, 123-45-6789, 10.20.30.40, key f32ab9bacb5b6b3f0f2b9f1ae9d8c7b6a5948372. Mrs. Anna Schmidt and Dr. Schmidt."
    out = pii.replace(spark.createDataFrame([(1, said), (2, said.lower())], "doc_id bigint, text string"), count="n")
    got = by_id(out)
    text = got[1].text
    for word in ("ann.lee72", "569", "555-7279", "4111", "123-45", "10.20.30.40", "f32ab9", "Schmidt", "Anna"):
        assert word not in text
    mails = re.findall(r"\S+@\S+\w", text)
    assert mails[0].upper() == mails[1] and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d\d@[a-z]{4}\d\.[a-z]{7}\.example", mails[0])
    phones = re.findall(r"\+1[ (\d)-]+\d", text)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0]) and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    cards = re.findall(r"\d{4}[ ]?\d{4}[ ]?\d{4}[ ]?\d{4}", text)
    assert cards[0].replace(" ", "") == cards[1] and luhn(cards[1]) and luhn("4111111111111111")
    names = re.search(r"Mrs\. (\w+a) (\w+) and Dr\. (\w+)\.", text)
    assert names and names[2] == names[3] and len(names[2]) == 7
    assert pii.replace(spark.createDataFrame([(1, said)], "doc_id bigint, text string"), key="other").first().text != text
    assert got[1].n == 11


def test_surrogates_stay_distinct(spark):
    r = random.Random(5)
    few = [(i, f"{a}@b.org") for i, a in enumerate("abcdefghijklmnopqrstuvwxyz")] + [(100 + i, f"call {r.randrange(1000):03d}-{r.randrange(100):02d}-{r.randrange(10000):04d}") for i in range(200)]
    out = by_id(pii.replace(spark.createDataFrame(few, "doc_id bigint, text string")))
    assert len({out[i].text for i, _ in few}) == len({t for _, t in few})
    assert not {out[i].text for i, _ in few} & {t for _, t in few}


def test_names_are_one_person_with_and_without_title(spark):
    said = [
        "John Smith met Dr John Smith and Mr. Smith; JOHN SMITH left. Smith and John came back.",
        "Contact: Alice Walker. My name is Zora Neale Hurston, Hurston for short. Mrs. Zora Quill.",
        "Frau Jürgen-Meyer und Herr Meyer, Jean-Luc ist kein Name; Ирина Иванова, госпожа Иванова.",
        "smith wrote to john, All Of The Above.",
    ]
    got = by_id(pii.replace(spark.createDataFrame(list(enumerate(said)), "doc_id bigint, text string")))
    m = re.fullmatch(r"(\w+) (\w+) met Dr (\w+) (\w+) and Mr\. (\w+); (\w+) (\w+) left\. (\w+) and (\w+) came back\.", got[0].text)
    assert m and m[1] == m[3] == m[9] and m[2] == m[4] == m[5] == m[8] and (m[6], m[7]) == (m[1].upper(), m[2].upper()) and m[1].istitle()
    assert not {"john", "smith"} & set(got[0].text.lower().split())
    m = re.fullmatch(r"Contact: (\w+) (\w+)\. My name is (\w+) (\w+) (\w+), (\w+) for short\. Mrs\. (\w+) (\w+)\.", got[1].text)
    assert m and m[5] == m[6] and m[3] == m[7] and m[1].endswith("a") and m[3].endswith("a")
    assert not {"Alice", "Walker", "Zora", "Neale", "Hurston", "Quill"} & set(m.groups())
    # consonants and vowels in turns, up to the ending
    assert all(re.fullmatch(r"(?:[b-df-hj-np-tvz][aeiou])*[a-z]{1,3}", x.lower()) for x in (m[1], m[2], m[3], m[5]))
    m = re.fullmatch(r"Frau (\w+-\w+) und Herr (\w+), Jean-Luc ist kein Name; ([А-Я]\w+) ([А-Я]\w+), госпожа (\w+)\.", got[2].text)
    assert m and m[4] == m[5] and m[4].endswith("ва") and "Иванова" not in got[2].text and m[1].istitle()
    assert got[3].text == said[3]


def test_numbers_of_few_digits_never_run_out(spark):
    rows = [(i, f"sum +1 {i // 10} {i % 10} end") for i in range(100)]
    out = pii.replace(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {(r.doc_id, r.text) for r in out.collect()} == set(rows)
    # more entities than there are of their length: those left over grow
    few = spark.createDataFrame([("phone", f"{i:02d}") for i in range(100)] + [("surname", a + b) for a in "abcdefgh" for b in "abcdefgh"] + [("given", a) for a in "abcdefghijklmnopqrstuvwxyz"], "kind string, canonical string")
    got = pii.surrogates(few).collect()
    assert len(got) == 190 == len({(r.kind, r.surrogate) for r in got}) and not {(r.kind, r.surrogate) for r in got} & {(r.kind, r.canonical) for r in got}


def test_surrogates_over_the_whole_table(spark):
    """Against an independent search for mail addresses, keys and card numbers: all go, equal ones to equal ones, others to others; the rest stays."""
    docs = documents(spark)
    before, after = {r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.text or "" for r in pii.replace(docs).collect()}
    plain = re.compile(r"[\w.]+@[\w.]+\.com\b|(?<![0-9a-zA-Z])[0-9a-f]{40}(?![0-9a-zA-Z])|(?<!\d)\d{16}(?!\d)")
    after_plain = re.compile(r"[\w.]+@[\w.]+\.example\b|(?<![0-9a-zA-Z])[0-9a-f]{40}(?![0-9a-zA-Z])|(?<!\d)\d{16}(?!\d)")
    pairs = set()
    assert set(before) == set(after)
    for i, text in before.items():
        old, new = plain.findall(text), after_plain.findall(after[i])
        assert len(old) == len(new)
        pairs.update(zip(old, new))
    assert len(pairs) > 5 and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
    assert not {a for a, _ in pairs} & {b for _, b in pairs}


def test_surrogate_edges(spark, clashing):
    out = pii.replace(clashing)
    assert out.columns == clashing.columns and sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (t for _, t, *_ in EDGES)))
    assert pii.replace(empty(spark)).count() == 0
    twice = spark.createDataFrame([(None, "a.b@c.org", 1), (None, "a.b@c.org", 1), (None, "d.e@c.org", 2)], "doc_id bigint, text string, id int")
    assert len({r.text for r in pii.replace(twice).collect()}) == 2 and pii.replace(twice).count() == 3


# --- 6 SentencePiece ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepiece_scan.Vocabulary.load(sentencepiece_scan.MODEL)


def plain_ids(v, text):
    """Viterbi over the whole text, from the right, longest piece first."""
    said = v.normal(text)
    return sentencepiece_scan.walk(v, said, v.best(said, len(said), np.zeros(1, np.int64)), 0)[0]


TEXTS = ["Hello world", "", "  two  spaces ", "naïve 日本語 🙂", "a\nb\t\x00c", "aaaaaaaaaaaaaaaa aaa", "x" * 300, "的一是不了人我在有他这" * 30]


def test_sentencepiece_batch(vocabulary):
    raw = [vocabulary.normal(t).encode() for t in TEXTS]
    ids, counts = sentencepiece_scan.encode_batch(vocabulary, np.concatenate(([0], np.cumsum([len(x) for x in raw]))), np.frombuffer(b"".join(raw), np.uint8))
    ends = np.cumsum(counts)
    for t, a, b in zip(TEXTS, ends - counts, ends):
        assert ids[a:b].tolist() == plain_ids(vocabulary, t)
        assert vocabulary.decode(ids[a:b].tolist()) == t


def test_sentencepiece_is_the_library_with_a_unigram_model(tmp_path):
    """The same pieces as a unigram model in the library: equal total scores, and equal ids where there are no ties."""
    data = bytearray(open(sentencepiece_scan.MODEL, "rb").read())
    v = sentencepiece_scan.Vocabulary.load(sentencepiece_scan.MODEL)
    out, at = bytearray(), 0

    def varint(n):
        o = bytearray()
        while n > 127:
            o.append(n & 127 | 128)
            n >>= 7
        return bytes(o + bytes([n]))

    for field, value in sentencepiece_scan._wire(bytes(data)):
        if field == 1:
            own = dict(sentencepiece_scan._wire(value))
            score = v.scores.get(own[1].decode(), (0, 0))[0] / sentencepiece_scan.SCALE
            value = b"\x0a" + varint(len(own[1])) + own[1] + b"\x15" + np.float32(score).tobytes() + (b"\x18" + varint(own[3]) if 3 in own else b"")
        elif field == 2:
            value = value.replace(b"\x18\x02", b"\x18\x01", 1)
        out += varint(field << 3 | 2) + varint(len(value)) + value
    path = tmp_path / "unigram.model"
    path.write_bytes(bytes(out))
    lib = sentencepiece.SentencePieceProcessor(model_file=str(path))
    v = sentencepiece_scan.Vocabulary.load(str(path))
    same = 0
    words = open(__file__).read().split("\n")[:120]
    for t in words:
        theirs, ours = lib.encode(t), plain_ids(v, t)
        assert v.worth[theirs].sum() == v.worth[ours].sum()
        same += theirs == ours
    assert same > 0.9 * len(words)


def test_transfer_matrices_combine(vocabulary):
    for text in ("some words in a row, and more", "的一是不了人我在有他这" * 3, "aaaaaaaaaaaaaaaaaaaaaaa"):
        said = vocabulary.normal(text)
        whole = vocabulary.transfer(said, len(said))[0, 0]
        for a, b in ((5, 9), (1, 2), (len(said) // 2, len(said) // 2 + 3)):
            parts = [vocabulary.transfer(said[x : y + vocabulary.longest - 1], y - x) for x, y in ((0, a), (a, b), (b, len(said)))]
            left = sentencepiece_scan.combine(sentencepiece_scan.combine(parts[0], parts[1]), parts[2])
            right = sentencepiece_scan.combine(parts[0], sentencepiece_scan.combine(parts[1], parts[2]))
            assert left[0, 0] == right[0, 0] == whole == vocabulary.worth[plain_ids(vocabulary, text)].sum()


def test_sentencepiece_chunks(spark, vocabulary, clashing, monkeypatch):
    monkeypatch.setattr(sentencepiece_scan, "CHUNK", 100)
    monkeypatch.setattr(sentencepiece_scan, "FAN", 3)
    texts = list(enumerate([*TEXTS, LONG[:3000], "的一是不了人我在有他这" * 90, None]))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    for giant in (1 << 16, 150):
        out = by_id(sentencepiece_scan.decode(sentencepiece_scan.encode(docs, giant=giant)))
        for i, t in texts:
            assert (out[i].ids, out[i].decoded) == ((None, None) if t is None else (plain_ids(vocabulary, t), t))
    extra = sentencepiece_scan.encode(clashing.drop("ids"), giant=10_000)
    assert extra.columns == [*clashing.drop("ids").columns, "ids"] and extra.count() == len(EDGES)
    assert sentencepiece_scan.encode(empty(spark)).count() == 0


# --- 7 HTML ----------------------------------------------------------------------------------


PAGE = '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="x"><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>{0}</h1>{1}<form><input>Send</form><section class="comments"><p>Nice!</p></section></article><aside>More</aside><div class="ad">Buy</div><!-- <p>no</p> --><footer>&copy; us</footer></body></html>'


def test_html_text(spark):
    pages = [(1, "http://a.org/1", PAGE.format("A &amp; B", "<p>one\n two<br>three <b>bold</b></p><p>next</p>")), (2, "http://a.org/2", PAGE.format("C", "<p>&lt;x&gt; &eacute;<ul><li>i<li>j</ul>")), (3, "http://a.org/3", PAGE.format("D", "")[:-40]), (4, None, None), (5, "nonsense", ""), (None, "http://b.org/", "<div><p>free " * 300), (6, "http://c.org/1", "<div id=main-menu>m</div><div class=story><p>unlike one</p></div>"), (7, "http://c.org/2", "<div id=main-menu>m</div><div class=story><p>other text</p></div>"), (7, "http://c.org/2", "<div id=main-menu>m</div><div class=story><p>other text</p></div>")]
    docs = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("slots", F.lit(1)).withColumn("text", F.lit("x"))
    rows = html_wrapper.extract(docs).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == "A & B\none two three bold\nnext" and got[2] == "C\n<x> é\ni\nj" and got[3] == "D"
    assert got[4] == "" and got[5] == "" and got[6] == "unlike one" and got[7] == "other text"
    assert html_wrapper.extract(docs.limit(0)).count() == 0


def test_html_is_decided_page_by_page(spark):
    """Hosts of two layouts, of one page and its copy, and pages without a host."""
    plain = '<nav>Menu</nav><div class=top>Site</div><div class=story><p>{}</p></div><div class=links><a href="/">{}</a></div>'
    pages = [(1, "http://mixed.org/1", "<article><p>within</p></article>"), (2, "http://mixed.org/2", plain.format("first", "a")), (3, "http://mixed.org/3", plain.format("second", "b"))]
    pages += [(4, "http://one.org/", plain.format("only", "c")), (5, "http://copy.org/", plain.format("same", "d")), (6, "http://copy.org/", plain.format("same", "d"))]
    pages += [(7, None, "<main>without a host</main>"), (8, None, "<section><p>another site</p></section>"), (9, "nonsense", "<div><p>a third</p></div>")]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == {1: "within", 2: "first", 3: "second", 4: "Site\nonly", 5: "Site\nsame", 6: "Site\nsame", 7: "without a host", 8: "another site", 9: "a third"}


def test_html_template_is_what_pages_of_a_host_share(spark):
    page = "<html><body><div>Our site</div><article class='post'><div class='article-header'><h1>{0}</h1></div><div>Tell a friend</div><div><h2>s{0}</h2><p>{1}</p><h2>t{0}</h2><p>more {1}</p></div><div class=comment-list>c{0}</div></article><div><a href=/>{0}</a></div></body></html>"
    pages = [(i, "http://a.org/", page.format(f"title {i}", f"text {i}")) for i in range(6)]
    # two pages are too few to take what they share from an article
    pages += [(10 + i, "http://b.org/", page.format("title", f"text {i}")) for i in range(2)]
    pages += [(20, "http://c.org/", "<div class='header-fixed sidebar-left'><h1>Title</h1><p>Real article text here.</p></div>")]
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"title {i}\nstitle {i}\ntext {i}\nttitle {i}\nmore text {i}"
    for i in range(2):
        assert got[10 + i] == f"title\nTell a friend\nstitle\ntext {i}\nttitle\nmore text {i}"
    assert got[20] == "Title\nReal article text here."


def test_html_against_brute_force_without_landmarks(spark):
    """Pages of random bodies in one frame, without article or main: the text is what differs from page to page, and no menu."""
    rng, pages, want = random.Random(7), [], {}
    for i in range(40):
        host, blocks, text = i % 4, [], []
        for j in range(rng.randint(1, 6)):
            tag, said = rng.choice(["p", "h2", "blockquote", "div class=part"]), f"said {i} {j} &amp; {rng.random()}"
            blocks.append(f"<{tag}>{said}</{tag.split()[0]}>")
            text.append(said.replace("&amp;", "&"))
        want[i] = "\n".join(text)
        pages.append((i, f"http://h{host}.org/{i}", f"<html><body><div class=top>Host {host}</div><div class=links><a href='/x'>link {i}</a></div><div class=body>{''.join(blocks)}</div><p>Sold by {host}</p></body></html>"))
    got = {r.page_id: r.text for r in html_wrapper.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == want


def test_html_is_parsed_in_linear_time():
    for page in ("<a " * 20_000, "<a b='" * 20_001, "<div>" * 20_000 + "x" + "</div>" * 20_000, "<" * 60_000, "<!--" * 20_000, "<i \"<i x>\" " * 10_000 + "'", "<div>" * 9_000 + "</b></span></q>" * 9_000):
        began = time.perf_counter()
        html_wrapper.blocks(page)
        assert time.perf_counter() - began < 2
    assert [t for _, t, _ in html_wrapper.blocks("<p>a < b <3 <p title='x>y'>c</p> <p title=\"z>d</p>")[1]] == ["a < b <3", "c", "d"]
    assert [t for _, t, _ in html_wrapper.blocks("<div>" * 300 + "in" + "</div>" * 300 + "<p>out")[1]] == ["in", "out"]


def test_wrapper_of_very_many_children():
    r = random.Random(2)
    trees = [html_wrapper.blocks(f"<section>{''.join(f'<div class=k{r.randrange(kinds)}>x</div>' for _ in range(3000))}</section>")[0] for kinds in (3, 3000, 3000)]
    began = time.perf_counter()
    wrapper = html_wrapper.align(html_wrapper.align(*trees[:2]), trees[2])
    assert time.perf_counter() - began < 5
    assert set(html_wrapper.slots(wrapper)) == set().union(*(html_wrapper.slots(t) for t in trees))


def test_html_by_join_where_wrappers_are_many(spark, monkeypatch):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet")
    near = {r.page_id: r.text for r in html_wrapper.extract(pages).collect()}
    monkeypatch.setattr(html_wrapper, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(html_wrapper, "GROUP", 2)
    assert {r.page_id: r.text for r in html_wrapper.extract(pages).collect()} == near
    for r in pages.collect():
        inner = re.sub(r"</?(?:p|h1)>", "\n", r.html[r.html.index("<article>") : r.html.index("</article>")])
        lines = (re.sub(r"\s+", " ", html.unescape(x)).strip() for x in re.sub("<[^>]*>", " ", inner).split("\n"))
        assert near[r.page_id] == "\n".join(x for x in lines if x)


def test_wrapper_is_a_union_free_expression():
    trees = [html_wrapper.blocks(f"<div><h2>t</h2>{x}</div>")[0] for x in ("<p>a</p>", "<p>a</p><p>b</p>", "<ul><li>x</li></ul>")]
    wrapper = html_wrapper.align(html_wrapper.align(trees[0], trees[1]), trees[2])
    assert html_wrapper.expression(wrapper) == "<div><h2>#text</h2>(<p>#text</p>)*(<ul><li>#text</li></ul>)?</div>"
    pairs = html_wrapper.blocks("<div>" + "<h2>t</h2><p>a</p>" * 1200 + "</div>")[0]
    assert html_wrapper.expression(pairs) == "<div>(<h2>#text</h2><p>#text</p>)+</div>"
    one = html_wrapper.blocks("<div><h2>t</h2><p>a</p></div>")[0]
    assert html_wrapper.expression(html_wrapper.align(one, pairs)) == html_wrapper.expression(html_wrapper.align(pairs, one)) == "<div>(<h2>#text</h2><p>#text</p>)+</div>"


# --- 8 near-duplicates ---------------------------------------------------------------------------


def brute_classes(docs):
    def seq(t):
        raw = LOWER[np.frombuffer((t or "").encode(), np.uint8)]
        return omh_dedup.shingles(Words(np.array([0, len(raw)]), raw, ALNUM), 5)[0]

    seqs = {i: seq(t) for i, t in docs}
    parent = {i: i for i in seqs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(seqs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(seqs[a]) and len(seqs[b]) and omh_dedup.aligned(seqs[a], seqs[b], 0.8) > 0:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    r = random.Random(3)
    for i, t in docs[:30]:
        w = t.split(" ")
        for copy in range(r.randint(0, 3)):
            own = list(w)
            for _ in range(len(w) // 60):
                own[r.randrange(len(own))] = "changed"
            docs.append((1000 + i * 5 + copy, " ".join(own)))
    found = omh_dedup.classes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {x.doc_id: x.class_id for x in found.collect()} == brute_classes(docs)


def test_near_duplicates_around_one_original(spark):
    """Copies that each are near their original, whose id is in the midst of theirs, but not near each other; and texts that share a passage."""
    rng, vocabulary = random.Random(5), [f"w{i}" for i in range(5000)]

    def edited(words):
        words = list(words)
        for at in rng.sample(range(len(words)), 5):
            words[at] = rng.choice(vocabulary)
        return words

    base, passage = rng.choices(vocabulary, k=300), rng.choices(vocabulary, k=150)
    groups = [[edited(base) for _ in range(12)] + [base] + [edited(base) for _ in range(12)]]
    for _ in range(8):
        text = passage + rng.choices(vocabulary, k=150)
        groups.append([text, edited(text)])
    groups += [[passage + rng.choices(vocabulary, k=150)] for _ in range(20)]
    docs, want = [], {}
    for group in groups:
        first = len(docs)
        for words in group:
            want[len(docs)] = first
            docs.append((len(docs), " ".join(words)))
    found = omh_dedup.classes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.doc_id: r.class_id for r in found.collect()} == want


def test_near_duplicates_within_a_template(spark):
    """Texts of one template, near each other in pairs by little more than it: they meet in the buckets of all only."""
    rng, vocabulary = random.Random(8), [f"w{i}" for i in range(5000)]
    template, docs = rng.choices(vocabulary, k=250), []
    for _ in range(40):
        own = rng.choices(vocabulary, k=3)
        docs += [" ".join(template + own + rng.choices(vocabulary, k=30)) for _ in range(2)]
    docs = list(enumerate(docs))
    want = brute_classes(docs)
    assert want == {i: i - i % 2 for i in range(80)}
    found = omh_dedup.classes(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.doc_id: r.class_id for r in found.collect()} == want


def test_alignment_is_the_longest_in_order():
    r = random.Random(1)
    for _ in range(40):
        a = r.sample(range(1000), 60)
        b = [x for x in a if r.random() > 0.1]
        i, j = sorted(r.sample(range(len(b)), 2))
        b[i], b[j] = b[j], b[i]
        matched = sum(m.size for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        got = omh_dedup.aligned(np.array(a, np.uint32), np.array(b, np.uint32), 0.5)
        assert got >= matched / (len(a) + len(b) - matched) - 1e-12
    assert omh_dedup.aligned(np.arange(10, dtype=np.uint32), np.arange(10, dtype=np.uint32)[::-1].copy(), 0.8) == 0


def test_near_duplicate_edges(spark, clashing):
    found = omh_dedup.classes(clashing).collect()
    assert len(found) == len(EDGES) and {(r.doc_id, r.class_id) for r in found} == {(i, i) for i in (1, 2, 3, None, 4, 5, 6)}
    out = omh_dedup.dedup(clashing.withColumn("doc_id", F.when(F.col("doc_id") == 6, 1).otherwise(F.col("doc_id"))))
    assert out.columns == clashing.columns and out.count() == len(EDGES)
    two = spark.createDataFrame([(8, "A b, c!"), (5, "a B c"), (9, "a b d")], "doc_id bigint, text string")
    assert {r.doc_id: r.class_id for r in omh_dedup.classes(two).collect()} == {5: 5, 8: 5, 9: 9}
    assert omh_dedup.dedup(two).count() == 2 and omh_dedup.classes(empty(spark)).count() == 0


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (102, 101)], "a bigint, b bigint")
    assert {r.id: r.label for r in components(chain).collect()} == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}


# --- 9 substring dedup ------------------------------------------------------------------------------


def brute_substrings(docs, k):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    first: dict = {}
    for i, w in sorted(words):
        for p in range(len(w) - k + 1):
            first.setdefault(tuple(w[p : p + k]), i)
    out = []
    for i, w in words:
        gone = {q for p in range(len(w) - k + 1) if first[tuple(w[p : p + k])] < i for q in range(p, p + k)}
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return sorted(out)


def found_substrings(spark, docs, **how):
    found = substring_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5), **how)
    return sorted((x.doc_id, x.n_words, x.n_removed, x.kept) for x in found.collect())


def test_substrings(spark):
    r = random.Random(9)
    docs = [(i, " ".join(r.choice("abcde") for _ in range(r.randint(0, 60)))) for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # runs of a key go over batches
    try:
        for k, m in ((4, 2), (6, 3), (3, 3)):
            assert found_substrings(spark, docs, k=k, m=m) == brute_substrings(docs, k)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError):
        substring_dedup.dedup(spark.createDataFrame(docs, "doc_id bigint, text string"), m=20)


def test_substrings_of_colliding_edges(spark):
    """Hashes of a few bits: most edges share one with others, and words decide."""
    r = random.Random(19)
    docs = [(i, " ".join(r.choice("abcde") for _ in range(r.randint(0, 60)))) for i in range(40)]
    for bits in (2, 6, 9):
        assert found_substrings(spark, docs, k=5, m=3, bits=bits) == brute_substrings(docs, 5)


def test_substrings_of_long_copies(spark):
    """Copies with changes here and there of a document of several blocks, and several rows of one doc_id."""
    r = random.Random(29)
    base = [f"w{r.randint(0, 400)}" for _ in range(700)]
    docs = [(0, "  ".join(base))]
    for i in range(1, 25):
        w = list(base[r.randint(0, 300) :])
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"x{i}"
        docs.append((i // 2, "\n".join(w)))  # two rows of each id, and two more of the first
    assert found_substrings(spark, docs) == brute_substrings(docs, 13)


def test_substring_edges(spark, clashing):
    found = substring_dedup.dedup(clashing.union(clashing.where("doc_id = 4").withColumn("doc_id", F.lit(9).cast("bigint"))))
    rows = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in found.collect())
    assert rows == sorted([("1", 14, 0), ("1", 14, 0), ("2", 0, 0), ("3", 0, 0), ("None", 14, 0), ("4", 60_000, 0), ("5", 2, 0), ("6", 0, 0), ("9", 60_000, 60_000)])
    assert substring_dedup.dedup(empty(spark)).count() == 0


# --- 10 WARC -------------------------------------------------------------------------------------------


def test_warc_dictionary_sample_is_bounded_on_repeats(spark):
    """Pages without ids, of two payloads a thousand times each and of many others once."""
    html = F.when(F.col("id") < 2000, F.concat(F.lit("same payload "), F.col("id") % 2)).otherwise(F.concat(F.lit("<p>page "), F.sha2(F.col("id").cast("string"), 256)))
    pages = spark.range(4000).select(F.lit(None).cast("bigint").alias("page_id"), F.lit(None).cast("string").alias("url"), html.alias("html"))
    archives = warc.write(pages)
    assert archives.where(F.hex(F.substring("content", 1, 4)) == "5D2A4D18").count() == archives.count() > 0
    assert warc.read(archives).count() == 4000


def test_warc(spark):
    body = "<p>payload</p>" * 20
    pages = spark.createDataFrame([(3, "http://a/3", body, 1), (1, "http://a/1 x\r\n", body, 1), (2, None, body, 1), (2, None, body, 1), (4, "u", "short", 1), (5, "u", "short", 1), (6, "u", None, 1), (None, "u", body, 1), (None, "u", "only" * 40, 1)], "page_id bigint, url string, html string, first int")
    archives = warc.write(pages.repartition(3), archive_bytes=300).collect()
    assert all(a.content[:4] == bytes.fromhex("5d2a4d18") for a in archives) and len(archives) > 1
    frame = archives[0]
    known = warc.zstandard.ZstdCompressionDict(frame.content[8 : 8 + int.from_bytes(frame.content[4:8], "little")])
    alone = warc.zstandard.ZstdDecompressor(dict_data=known).decompressobj().decompress(frame.content[frame.offsets[-1] :])
    assert alone.startswith(b"WARC/1.1\r\n")  # a record by its offset
    got = warc.read(spark.createDataFrame(archives)).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted([("1", 280, sha(body), "response", None), ("2", 280, sha(body), "revisit", 1), ("2", 280, sha(body), "revisit", 1), ("3", 280, sha(body), "revisit", 1), ("4", 5, sha("short"), "response", None), ("5", 5, sha("short"), "response", None), ("6", 0, sha(""), "response", None), ("None", 280, sha(body), "response", None), ("None", 160, sha("only" * 40), "response", None)])
    assert {r.url for r in got} == {"http://a/3", "http://a/1%20x%0D%0A", None, "u"}
    assert warc.write(pages.limit(0)).count() == 0
    broken = bytearray(archives[0].content)
    broken[-20] ^= 255
    with pytest.raises(Exception):
        list(warc.parse(bytes(broken)))
