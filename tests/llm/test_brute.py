"""Operators against plain versions of what they compute, on the small tables and on drawn inputs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from talkweft.llm import best_fit, flac_media, line_crf, quality_rules, queries, secret_scan, sentence_pieces, token_records, warc_archive

DATA = "/root/testdata/sf0.001"
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


@pytest.fixture(scope="session")
def docs(spark):
    return sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())


def plain_spans(data: bytes):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(rb"AKIA[A-Z0-9]+", data) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(rb"[0-9a-f]+", data) if len(m[0]) >= 32]
    return sorted(found)


def test_secret_automaton():
    made, rng = secret_scan.compiled(), random.Random(1)
    parts = ["token", "secret", "api_key", "API", "key", "=", ":", " ", "'", '"', "AKIA", "A1", "0a", "deadbeef", "0123456789abcdef", "é", "x", "-", "password", "PASSWD", "."]
    for _ in range(3000):
        data = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))).encode()
        assert [s for s in secret_scan.scan(data, made) if s[1] < 3] == plain_spans(data)


def test_flac_round_trip_and_checks():
    tables, rng = (flac_media.crc8_table(), flac_media.crc16_table()), random.Random(2)
    data = [flac_media.payload_of(t)[1] for t in ("", "text " * 900, "é" * 3000)] + [rng.randbytes(576 * 30), bytes(576), bytes(range(256)) * 9]
    streams = flac_media.encode_many(data, tables)
    assert flac_media.decode_many(streams, tables) == data
    _, _, _, where = flac_media._frames_of(streams[1])
    a, b = where[3]
    frame = streams[1][a:b]
    n, at = flac_media._open(frame, tables[0])
    assert bytes(v + 128 for v in flac_media._subframe(frame[at:-2], n, 8)) == data[1][576 * 3 : 576 * 4]
    bad = bytearray(streams[1])
    bad[a + 20] ^= 1
    with pytest.raises(flac_media.FlacError):
        flac_media.decode_many([bytes(bad)], tables)


def test_flac_encodes_linear_predictors_and_seeks():
    """Frames with fitted coefficients decode alike by the fast and the bitwise reader; any range is read by its sample offset."""
    tables, rng = (flac_media.crc8_table(), flac_media.crc16_table()), random.Random(7)
    words = ["lorem", "ipsum", "dolor", "sit", "amet", "é", "Zürich", "and", "the", "\n"]
    data = [flac_media.payload_of(" ".join(rng.choice(words) for _ in range(n)))[1] for n in (3, 900, 6000)]
    data.append(bytes(int(128 + 100 * np.sin(i / 7)) for i in range(576 * 20)))
    data.append(bytes(int(128 + 60 * np.sin(1.9 * i) + 50 * np.sin(2.6 * i)) for i in range(576 * 20)))  # only a fitted predictor foresees two high tones
    kinds = Counter()
    for stream, want in zip(flac_media.encode_many(data, tables), data, strict=True):
        assert flac_media.decode_many([stream], tables) == [want]
        for i, (a, b) in enumerate(flac_media._frames_of(stream)[3][:12]):
            n, at = flac_media._open(stream[a:b], tables[0])
            kinds[stream[a + at] >> 1 & 63] += 1
            assert bytes(v + 128 for v in flac_media._subframe(stream[a + at : b - 2], n, 8)) == want[576 * i : 576 * i + 576]
        for _ in range(20):
            start, n = rng.randint(0, len(want)), rng.randint(0, 3000)
            assert flac_media.read_samples(stream, start, n, tables) == want[start : start + n]
    assert kinds[32 + flac_media.LPC_ORDER - 1] > 10


def test_flac_linear_prediction():
    """A frame with LPC coefficients, written by hand, decodes to the samples it was made from."""
    samples, coef, shift = [3, 5], [3, -1], 1
    residual = [1, -2, 0, 4, -1, 2]
    for r in residual:
        samples.append(r + ((coef[0] * samples[-1] + coef[1] * samples[-2]) >> shift))
    bits = f"0{32 + 1:06b}0" + "".join(f"{v & 255:08b}" for v in samples[:2]) + f"{3:04b}{shift:05b}" + "".join(f"{c & 15:04b}" for c in coef) + "00" + "0000" + f"{1:04b}"
    for r in residual:
        u = 2 * r if r >= 0 else -2 * r - 1
        bits += "0" * (u >> 1) + "1" + str(u & 1)
    bits += "0" * (-len(bits) % 8)
    assert flac_media._subframe(int(bits, 2).to_bytes(len(bits) // 8, "big"), len(samples), 8) == samples


def test_pieces_scan_equals_library(docs):
    from sentencepiece import SentencePieceProcessor

    lattice, library = sentence_pieces.Lattice(sentence_pieces.default_model()), SentencePieceProcessor(model_file=sentence_pieces.default_model())
    rng = random.Random(3)
    for text in [t for _, t in docs[:15]] + ["漢字" * 300 + "x" * 200, "a" * 300, " a  b   c" * 60, "".join(rng.choice("aeinorst \n.é") for _ in range(900))]:
        want = library.encode(text)
        assert sentence_pieces.encode_text(lattice, text) == want
        for chunk in (45, 300):
            parts = sentence_pieces.chunks_of(sentence_pieces.marked(text), chunk, lattice.longest)[:400]
            if len(parts) < 400:
                matrices = [sentence_pieces.transfer(lattice, *p) for p in parts]
                at = sentence_pieces.states(matrices, 0, None)
                ids = [sentence_pieces.trace(lattice, *p, a, b)[0] for p, a, b in zip(parts, at[:-1], at[1:], strict=True)]
                assert [i for x in ids for i in x] == want


def test_pieces_chunked_in_spark(spark, docs):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").limit(40)
    whole = {r.doc_id: r for r in sentence_pieces.encode_pieces(rows).collect()}
    cut = {r.doc_id: r for r in sentence_pieces.encode_pieces(rows, chunk=300).collect()}
    assert {k: (v.n_pieces, v.decoded) for k, v in cut.items()} == {k: (v.n_pieces, True) for k, v in whole.items()}


def test_pieces_keep_ids_and_decode(spark, docs):
    """Stored ids equal the library's whether or not texts are cut, and decode to the given texts."""
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=sentence_pieces.default_model())
    texts = dict(docs[:20]) | {-1: "", -2: None, -3: "漢字 é😀 " * 200, -4: "a\u2581b " * 200}
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    made = [sentence_pieces.encode_pieces(rows, chunk=c) for c in (300, sentence_pieces.CHUNK)]
    cut, whole = ({r.doc_id: r for r in m.collect()} for m in made)
    assert cut == whole and {i: r.ids for i, r in cut.items()} == {i: library.encode(t or "") for i, t in texts.items()}
    assert {i for i, r in cut.items() if not r.decoded} == {-4}
    back = {r.doc_id: r.text for r in sentence_pieces.decode_pieces(made[0]).collect()}
    assert back == {i: (t or "").replace("\u2581", " ") for i, t in texts.items()}


def test_bounds_of_rules():
    for k, n in ((0, 100), (3, 50), (10, 1000)):
        p = quality_rules.upper_bound(k, n, 0.05)
        below = sum(np.exp(sum(np.log(n - i) - np.log(i + 1) for i in range(j)) + j * np.log(p) + (n - j) * np.log1p(-p)) for j in range(k + 1))
        assert abs(below - 0.05) < 1e-6
    assert quality_rules.upper_bound(5, 5, 0.05) == 1.0


def test_rule_counts(docs):
    for _, text in docs[:80] + [(0, "a a a a b"), (0, "x y z x y z x")]:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often, marked = Counter(windows), set()
        for k, w in enumerate(windows):
            if often[w] > 1:
                marked |= {k, k + 1, k + 2}
        got = quality_rules.measures(text)
        assert got[:3] == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))) and got[4] == len(marked)


def test_rules_control_rejection(spark):
    rows = [{"stratum": "en", "quality": q, "rule": 0, "bin": b, "n": n} for q, b, n in ((1, 0, 9000), (1, 20, 300), (1, 40, 2), (0, 40, 500), (0, 20, 100))]
    cuts = quality_rules.choose_cutoffs(rows)["en"]
    assert cuts[0] == 21 or 21 <= cuts[0] <= 40
    assert cuts[1:] == [quality_rules.GRID] * 4
    few = [r | {"n": max(1, r["n"] // 100)} for r in rows]
    assert quality_rules.choose_cutoffs(few)["en"][0] == quality_rules.GRID


def test_rules_of_small_strata():
    """230 good documents certify a stratum's own cutoffs where none is lost; fewer take the pool's."""
    rows = [{"stratum": s, "quality": q, "rule": i, "bin": b if i == 0 else 0, "n": n} for s, q, b, n in (("de", 1, 0, 230), ("de", 0, 30, 20), ("en", 1, 0, 2000), ("en", 0, 40, 90), ("es", 1, 0, 10)) for i in range(5)]
    cuts = quality_rules.choose_cutoffs(rows)
    assert cuts["de"][0] == 30 and cuts["en"][0] == 40 and cuts["es"][0] == cuts[quality_rules.OTHER][0] == 30
    assert all(c[1:] == [quality_rules.GRID] * 4 for c in cuts.values())
    rows = [r for r in rows if r["stratum"] == "en" and r["rule"] != 4]
    rows += [{"stratum": "en", "quality": q, "rule": 4, "bin": b, "n": n} for q, b, n in ((1, 50, 100), (1, 0, 1900), (0, 50, 1), (0, 0, 89))]
    assert quality_rules.choose_cutoffs(rows)["en"] == [40] + [quality_rules.GRID] * 4  # a bad cell of another rule stops nothing before it


def test_rules_reject_in_every_language(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op5_rules(spark, d).where("NOT base_failed").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        good, bad = ([r.kept for r in got if r.lang == lang and r.quality == q] for q in (1, 0))
        assert not any(bad) and sum(good) >= (1 - quality_rules.ALPHA) * len(good)


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(4)
    counts = np.array([3, 1, 4])
    unary, trans = rng.normal(size=(8, 2)), rng.normal(size=(2, 2))
    gamma, pair = line_crf.forward_backward(unary, trans, counts)
    at, pairs = 0, np.zeros((2, 2))
    for c in counts:
        weight = {}
        for path in product((0, 1), repeat=int(c)):
            weight[path] = np.exp(sum(unary[at + t, s] for t, s in enumerate(path)) + sum(trans[a, b] for a, b in zip(path, path[1:], strict=False)))
        z = sum(weight.values())
        for t in range(c):
            assert abs(gamma[at + t, 1] - sum(w for p, w in weight.items() if p[t]) / z) < 1e-9
        for p, w in weight.items():
            for a, b in zip(p, p[1:], strict=False):
                pairs[a, b] += w / z
        at += c
    assert np.allclose(pairs, pair)


def test_classifier_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op7_line_crf(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_packing():
    rng = random.Random(5)
    sizes = sorted((rng.randint(1, 8192) if rng.random() < 0.3 else rng.randint(1, 400) for _ in range(3000)), reverse=True)
    placed = best_fit.pack(sizes)
    room = Counter()
    for s, (b, length, at) in zip(sizes, placed, strict=True):
        assert at == room[b] and at + s <= length
        room[b] += s
    lengths = dict((b, length) for b, length, _ in placed)
    assert all(min(x for x in best_fit.LENGTHS if x >= room[b]) == length for b, length in lengths.items())
    assert sum(sizes) / sum(lengths.values()) > 0.97


def test_records(spark, docs):
    from tokenizers import Tokenizer

    from talkweft.llm.tokens import default_vocabulary

    t, start = Tokenizer.from_file(default_vocabulary()), 0
    got = {r.doc_id: r for r in queries.op10_records(spark, DATA).collect()}
    for i, text in docs:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    data = bytearray(token_records.frame(7, np.array([1, 2, 70000])))
    assert token_records.unframe(memoryview(bytes(data)))[1].tolist() == [1, 2, 70000]
    data[25] ^= 1
    with pytest.raises(ValueError):
        token_records.unframe(memoryview(bytes(data)))


def test_archive_bytes():
    made = [warc_archive.record(i, f"http://h/{i}", b"<p>body</p>" * i, None) for i in range(1, 300)]
    trained = warc_archive.dictionary(made)
    import zstandard

    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    data = warc_archive.leading_frame(trained) + b"".join(z.compress(m) for m in made)
    assert trained and data[:4] == b"\x5d\x2a\x4d\x18" and [m for _, m in warc_archive.read_archive(data)] == made


@pytest.mark.parametrize("stars", [True, False])
def test_near_duplicates(spark, docs, stars, monkeypatch):
    """With stars, and by the inverted join alone."""
    from talkweft.llm import near_dup

    if not stars:
        monkeypatch.setattr(near_dup, "_stars", lambda classes: classes.sparkSession.createDataFrame([], "a long, b long"))

    def shingles(x):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), x))
        return set(zip(w, w[1:], strict=False)) if len(w) > 1 else {tuple(w)} if w else set()

    sets, up = {i: shingles(t) for i, t in docs}, {i: i for i, _ in docs}

    def top(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sets:
        for b in sets:
            x, y = sets[a], sets[b]
            if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y):
                low, high = sorted((top(a), top(b)))
                up[high] = low
    got = {r.doc_id: r for r in queries.op9_near_dup(spark, DATA).collect()}
    assert {i: (r.component_id, r.n_shingles) for i, r in got.items()} == {i: (top(i), len(sets[i])) for i in sets}


def test_flac_media_is_stored_and_seekable(spark):
    """op3 reads media that was written; a block's bytes are the payload's at its offset; features of blocks are the whole's."""
    import hashlib

    assert any("flac-media" in f for f in queries.op3_flac(spark, DATA).inputFiles())
    texts = {1: "", 2: "short", 3: "é word " * 30_000, 4: "x" * flac_media.PCM_BLOCK}
    media = flac_media.encode_flac(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    payloads, blocks = {i: flac_media.payload_of(t)[1] for i, t in texts.items()}, flac_media.decode_flac(media).collect()
    for i, data in payloads.items():
        own = [b for b in blocks if b.doc_id == i]
        assert [b.sample_offset for b in own] == list(range(0, len(data), flac_media.PCM_BLOCK))
        assert all(bytes(b.pcm) == data[b.sample_offset : b.sample_offset + b.n_samples] for b in own) and sum(b.n_samples for b in own) == len(data)
    for r in flac_media.media_features(media).collect():
        data = payloads[r.doc_id]
        s = (np.frombuffer(data, np.uint8) ^ 128).view(np.int8).astype(int)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]))
        assert r.feature == f"sum={s.sum()};energy={(s * s).sum()};crossings={np.count_nonzero((s[1:] < 0) != (s[:-1] < 0))};low={s.min()};high={s.max()}"
