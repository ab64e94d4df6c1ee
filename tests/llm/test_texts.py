"""Word scanning, token ids, token files, quality rules and packing against plain Python."""

import collections
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from sparrowgrid.llm import elias_fano, packing, quality_rules, token_output, tokens
from sparrowgrid.llm import wordkernel as wk

SPACE = rb"[^\x20\x09-\x0d]+"
TEXT = st.text(alphabet=st.sampled_from("ab.'sé́　 \n\t\r 😀1<|>"), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=12))
def test_scan(texts):
    seen, hashes = [], {}
    for low, high, words in wk.scan_column(pa.array(texts, pa.string()), lower=False):
        for k in range(high - low):
            a, b = words.first[k], words.first[k + 1]
            own = [words.data[s:e].tobytes() for s, e in zip(words.start[a:b], words.end[a:b], strict=True)]
            for w, h in zip(own, words.hash[a:b].tolist(), strict=True):
                assert hashes.setdefault(w, h) == h
            seen.append(own)
    assert seen == [re.findall(SPACE, (t or "").encode()) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_scan_lowers():
    (_, _, words), = wk.scan_column(pa.array(["Ab É aB é"]))
    a, b, c, d = words.hash.tolist()
    assert a == c and b != d


@pytest.mark.parametrize(("name", "style"), [("word_bpe_49k.json", tokens.END_OF_WORD), ("byte_bpe_50k.json", tokens.BYTE_LEVEL)])
def test_ids_are_the_librarys(name, style):
    import random

    rng = random.Random(3)
    odd = ["".join(rng.choice("ab'sst.,  \n\t 　 \xa0\x1c\x85é́Σİ<|endoftext|>12😀\x00\x01") for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    texts = [*odd, "<|endoftext|> a", "  ", " \n a", "a \n", " a", "", None, "x" * 3000, "word, word. Word"]
    encoder = tokens.encoder(name, style)
    found = [ids[i:j].tolist() for _, _, ids, b in encoder.encode(pa.array(texts)) for i, j in zip(b[:-1], b[1:], strict=True)]
    assert found == [e.ids for e in encoder._tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("name", "style", "want"), [("word_bpe_49k.json", tokens.END_OF_WORD, [806, 49407, 1572]), ("byte_bpe_50k.json", tokens.BYTE_LEVEL, [437, 220, 50256, 923])])
def test_added_tokens_are_the_librarys(name, style, want):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = ["end <|endoftext|> start", "a<|endoftext|>b", "<|EndOfText|> x", " <|startoftext|> y", "plain words", None, "<|endoftext|>", " tail <|endoftext|> ", "plain words"]
    found = [ids[i:j].tolist() for _, _, ids, b in tokens.encoder(name, style).encode(pa.array(texts)) for i, j in zip(b[:-1], b[1:], strict=True)]
    fresh = Tokenizer.from_file(public_tokenizers.path(name))
    assert found[0] == want and found == [fresh.encode(t or "", add_special_tokens=False).ids for t in texts]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(values):
    values = np.array(sorted(values), np.int64)
    f = elias_fano.EliasFano(elias_fano.encode(values, int(values[-1]) if len(values) else 0))
    n = len(values)
    assert f.select_range(0, n).tolist() == values.tolist()
    for low in {0, n // 3, max(n - 1, 0)}:
        for high in {low, (low + n) // 2, n}:
            assert f.select_range(low, high).tolist() == values[low:high].tolist()
    assert [f.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(200, 1800, 20_000))
    assert 8 * len(elias_fano.encode(values, int(values[-1]))) / len(values) < 13


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], "doc_id long, text string, lang string, rank string, n_docs long")


ROWS = [(5, "one two three"), (2, ""), (9, None), (2, "again two"), (7, "A, b.\nc " * 900), (None, "no number"), (-3, "minus"), (7, "A, b.\nc " * 900)]


def test_token_files(spark, tmp_path):
    path = f"file://{tmp_path}/ids"
    manifest = token_output.write(docs(spark, ROWS), path, "word_bpe_49k.json", tokens.END_OF_WORD, 2, file_ids=2000)
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_output.read(spark, path, manifest).collect()))
    encoder = tokens.encoder("word_bpe_49k.json", tokens.END_OF_WORD)
    ids = {t: [*e.ids, 2] for t, e in zip({t or "" for _, t in ROWS}, encoder._tokenizer.encode_batch_fast(list({t or "" for _, t in ROWS}), add_special_tokens=False), strict=True)}
    assert sorted((d is None, d or 0, n, c) for _, d, n, c in got) == sorted((d is None, d or 0, len(ids[t or ""]), zlib.crc32(np.array(ids[t or ""], "<u4").tobytes())) for d, t in ROWS)
    assert [d for _, d, _, _ in got] == [None, -3, 2, 2, 5, 7, 7, 9]
    assert [s for s, *_ in got] == np.cumsum([0, *(n for _, _, n, _ in got[:-1])]).tolist()
    with (tmp_path / "ids" / manifest.first().name).open("rb") as raw:
        f = elias_fano.TokenFile(pa.PythonFile(raw))
        assert [f.document(k).tolist()[-1] for k in range(f.n_docs)] == [2] * f.n_docs


def test_token_files_empty(spark):
    assert token_output.written_and_read(docs(spark, [])).collect() == []


def _check_packing(pieces, rows, length=2048):
    encoder = tokens.encoder("byte_bpe_50k.json", tokens.BYTE_LEVEL)
    want = collections.Counter()
    for d, t in rows:
        ids = [*encoder._tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    covered = collections.Counter()
    for r in pieces:
        covered[r.doc_id] += r.length
    total = collections.Counter()
    for (d, n, _), k in want.items():
        total[d] += n * k
    assert covered == total
    sequences = collections.defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    padding = 0
    for own in sequences.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert 0 < at <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    whole = {(r.doc_id, r.doc_tokens, r.ids_crc32) for r in pieces if r.length == r.doc_tokens}
    assert whole <= set(want)
    return padding / max(1, sum(total.values()) + padding)


def test_packing(spark):
    rng = np.random.default_rng(4)
    rows = [*ROWS, *((k, "word " * int(n)) for k, n in enumerate(rng.integers(0, 5000, 300), 100))]
    pieces = packing.pack(docs(spark, rows)).collect()
    assert _check_packing(pieces, rows) < 0.01
    _check_packing(packing.pack(docs(spark, ROWS[:3])).collect(), ROWS[:3])
    assert packing.pack(docs(spark, [])).collect() == []


def test_columns_cover_demand():
    demand = np.zeros(65, np.int64)
    demand[[30, 34, 20, 44, 64, 1]] = [100, 100, 50, 50, 7, 3]
    found = packing.column_generation(demand, 64)
    used = sum(c * w for c, w in found)
    assert (used <= demand + 1e-6).all() and all(c @ np.arange(65) >= 63 for c, _ in found)
    assert used @ np.arange(65) >= 0.98 * (demand @ np.arange(65))
    plan = packing.solve(demand, 64)
    assert (plan.covered <= demand).all()


def test_knapsack():
    value, counts = packing.knapsack(np.array([-1, 0.1, 0.5, -1, 0.9, -1]), 5)
    assert value == pytest.approx(1.1) and counts.tolist() == [0, 1, 2, 0, 0, 0]


def plain_counts(t):
    t = t or ""
    words = [w.decode() for w in re.findall(SPACE, t.encode())]
    windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    repeated = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines, seen, dup = t.split("\n"), set(), 0
    for x in lines:
        if re.search(SPACE, x.encode()):
            dup += x in seen
            seen.add(x)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(repeated)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab #é\n\t|"), max_size=60)), min_size=1, max_size=8))
def test_base_counts(texts):
    got = quality_rules.base_counts(pa.array(texts, pa.string()))
    assert list(zip(*(got[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), strict=True)) == [plain_counts(t) for t in texts]


def test_quality(spark):
    import random

    rng = random.Random(5)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(800))
    noise = " ".join("".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(12)) for _ in range(300))
    loop = " ".join(f"word{k % 40} and" for k in range(3000))
    rows = [(1, prose), (2, noise), (3, loop), (4, None), (5, ""), (6, "a b"), (None, prose)]
    got = {(r.doc_id, r.n_words): (r.base_failed, r.kept) for r in quality_rules.assess(docs(spark, rows)).collect()}
    assert got[1, 800] == got[None, 800] == (False, True)
    assert got[2, 300] == (False, True) and got[3, 6000] == (True, False)
    assert got[4, 0] == got[5, 0] == (True, False)
    kept = quality_rules.keep_good(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "rank", "n_docs"] and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2]
    assert quality_rules.assess(docs(spark, [])).collect() == []


def test_bands():
    compressor = zstandard.ZstdCompressor(level=3)
    assert quality_rules.compression(b"", compressor) == (0.0, 0.0)
    assert quality_rules.compression(b"ab" * 50_000, compressor)[1] == 1.0
    assert [quality_rules.band_of(n).least_bytes for n in (0, 499, 500, 99_999)] == [0, 0, 500, 50_000]


def test_noise_and_half_repetition_are_rejected():
    import base64
    import random

    rng = random.Random(8)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    raw = lambda n: base64.b64encode(rng.randbytes(n)).decode()[:n]
    prose = " ".join(word("etaoinshrdlu") for _ in range(4000))
    noise = [(" " if width == 8 else "\n").join(x[k : k + width] for k in range(0, n, width)) for n in (2500, 8000, 60_000) for width in (8, 40) for x in (raw(n),)]
    noise += [" ".join(word("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n)) for n in (200, 1000, 9000)]
    halves = [prose[:6000] + "\n" + " ".join(x[k : k + 8] for k in range(0, 5500, 8)) for x in (raw(5500),)] + [prose[:6000] + " again and again" * 380]
    texts = [prose[:700], prose[:3000], prose[:9000], prose, *noise, *halves]
    found = quality_rules.metrics(pa.array(texts))["kept"].tolist()
    assert found == [True] * 4 + [False] * (len(noise) + len(halves))


def thue_morse(n):
    return ["".join("ab"[(k.bit_count() & 1) ^ flip] for k in range(n)) for flip in (0, 1)]


def test_words_that_polynomials_confuse():
    """Thue-Morse words and their complements have equal hashes by any polynomial modulo a power of two."""
    for n in (1024, 2048):
        a, b = thue_morse(n)
        (_, _, words), = wk.scan_column(pa.array([f"{a} {b} {a}"]))
        x, y, z = words.hash.tolist()
        assert x == z != y
        sets = wk.shingle_sets(next(wk.scan_column(pa.array([a, b])))[2], 4)
        assert not set(sets[0].tolist()) & set(sets[1].tolist())
        pair = f"{a} {a} {a} {b} {b} {b}"
        assert quality_rules.base_counts(pa.array([pair]))["n_repeat_words"].tolist() == [0]
        lines = " ".join([a, b] * 3)
        assert quality_rules.base_counts(pa.array([lines]))["n_repeat_words"].tolist() == [6]


@pytest.mark.parametrize(("name", "style"), [("word_bpe_49k.json", tokens.END_OF_WORD), ("byte_bpe_50k.json", tokens.BYTE_LEVEL)])
def test_ids_don_t_depend_on_hashes(name, style, monkeypatch):
    """Pieces that share a hash keep their own ids: all pieces of a length get one of two hashes here."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(wk, "EXACT", 0)
    monkeypatch.setattr(wk, "stretch_hashes", lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(2))
    a, b = thue_morse(1024)
    texts = ["alpha bravo gamma delta", "bravo alpha omega theta", f"{a} {b}", f"{b} {a}", "x y z", None]
    encoder = tokens.PieceEncoder(public_tokenizers.path(name), style)
    for _ in range(2):
        found = [ids[i:j].tolist() for _, _, ids, bounds in encoder.encode(pa.array(texts)) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
        assert found == [x.ids for x in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


def test_packing_takes_no_longer_for_more_items():
    import time

    plans = []
    for n in (10**4, 10**7, 10**12):
        demand = np.zeros(513, np.int64)
        demand[300] = n
        began = time.perf_counter()
        plans.append(packing.solve(demand, 512))
        assert time.perf_counter() - began < 20
        assert plans[-1].units == 300 * n and len(plans[-1].starts[300]) == 0
    mixed = np.random.default_rng(1).integers(1, 10**9, 513)
    plan = packing.solve(mixed, 512)
    assert plan.sequences * 512 + plan.units - 512 * 2 <= (mixed[1:] * np.arange(1, 513)).sum() * 1.01
    for pattern, times in packing.full_patterns(np.r_[0, np.full(512, 7)], 512):
        assert times > 0 and pattern @ np.arange(513) >= 511


def test_select_range_over_many_samples():
    values = np.cumsum(np.random.default_rng(3).integers(0, 3000, 5000))
    f = elias_fano.EliasFano(elias_fano.encode(values, int(values[-1])))
    for low, high in ((0, 5000), (255, 257), (256, 512), (300, 4999), (4999, 5000), (511, 513), (1024, 1024)):
        assert f.select_range(low, high).tolist() == values[low:high].tolist() == [f.select(i) for i in range(low, high)]
    with pytest.raises(IndexError):
        f.select_range(0, 5001)
