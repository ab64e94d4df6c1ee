"""Components, n-gram join, line dedup and decontamination against brute force."""

import collections
import random
import re
import tracemalloc

import numpy as np
import pytest

from sparrowgrid.llm import common, components, decontamination, line_dedup, ngram_join, units


def brute_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("finish", [0, 100_000])
def test_components(spark, finish):
    rng = random.Random(finish)
    edges = [(k, k + 1) for k in range(60)] + [(500, 500 + k) for k in range(1, 80)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7), (None, 1), (3, None), (1, 0)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(5), finish).collect()}
    assert got == {x: r for x, r in brute_components(edges).items() if x != r}


def test_components_empty(spark):
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingles(text, width=4):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode())]
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}


def brute_join(rows, width=4, percent=85):
    sets = [shingles(t, width) for _, t in rows]
    edges = [(i, i) for i, _ in rows]
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if sets[x] and sets[y] and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                edges.append((rows[x][0], rows[y][0]))
    roots = brute_components(edges)
    return collections.Counter((i, len(s), roots[i]) for (i, _), s in zip(rows, sets, strict=True))


def corpus(seed, groups=12, size=10):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((3, 8, 60, 150)))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 5)) if len(own) > 8 else 0):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own += passage
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in own))
    rng.shuffle(rows)
    return list(enumerate(rows))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, root string, n long, rep string")


def joined(spark, rows, **how):
    return collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(docs(spark, rows), **how).collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_join(spark, seed):
    rows = [*corpus(seed), (900, ""), (901, None), (902, "  \n"), (903, "two words"), (904, "Two  WORDS"), (0, corpus(seed)[0][1])]
    assert joined(spark, rows) == brute_join(rows)


def test_join_by_chains_and_blocks(spark, monkeypatch):
    """Long columns give chains, and large clusters are split in pairs of blocks."""
    monkeypatch.setattr(ngram_join, "LONG", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT", 2)
    monkeypatch.setattr(ngram_join, "UNIT_NGRAMS", 1000)
    monkeypatch.setattr(ngram_join, "UNIT_DOCS", 4)
    monkeypatch.setattr(common, "LARGE_ROWS", 2)
    copies = corpus(3, groups=4, size=30)
    rows = copies + [(1000 + k, copies[0][1]) for k in range(9)]
    assert joined(spark, rows, width=5, percent=80) == brute_join(rows, 5, 80)


def test_join_other_cases(spark):
    assert ngram_join.ngram_components(docs(spark, [])).collect() == []
    rows = [(1, "a b c d e"), (None, "a b c d e"), (None, None), (1, "x y z u v"), (0, "x y z u v")]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.component_id) for r in ngram_join.ngram_components(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(False, 0, 0), (False, 1, 0), (False, 1, 0), (True, 0, 0), (True, 0, None)], key=str)
    kept = ngram_join.keep_one_of_each(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "root", "n", "rep"] and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (True, 0), (True, 0)]


def test_staged_tables_collect_the_drivers_garbage(spark):
    """Shuffles and broadcasts of finished steps go when the driver's heap is collected as a whole: each staged table has it done."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    full = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    for k in range(3):
        common.staged(spark.range(20), f"collected-{k}")
    assert full() >= before + 3


def test_pairs_in_small_portions(spark, monkeypatch):
    """Portions of pairs change nothing but the memory of a task."""
    monkeypatch.setattr(ngram_join, "PAIRS", 8)
    rows = corpus(5, groups=6)
    assert joined(spark, rows) == brute_join(rows)


def test_units_product_stays_small(monkeypatch):
    """A unit's product takes no more than its matrix and a few rows beside it, and parts of it give the whole's links."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(np.r_[base[rng.random(300) < 0.97], rng.integers(0, 1 << 62, 9).astype(np.uint64)]) for _ in range(1_024)]
    numbers = rng.permutation(5_000)[:1_024]
    tracemalloc.start()
    whole = ngram_join.unit_links(numbers, sets, 85)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(whole[0]) and peak < 28 << 20
    monkeypatch.setattr(ngram_join, "SUMMED", 1 << 12)
    monkeypatch.setattr(ngram_join, "ROWS", 7)
    parts = ngram_join.unit_links(numbers, sets, 85)
    assert [x.tolist() for x in whole] == [x.tolist() for x in parts]


def test_most_frequent_ngrams_are_merged_by_tasks(spark):
    """The driver gets one list of at most so many keys, whatever the number of tasks; equal numbers go by key."""
    rng = np.random.default_rng(3)
    rows = [(rng.choice(10_000, 50, replace=False) + 10_000 * k, rng.integers(33, 40, 50)) for k in range(24)]
    often = spark.createDataFrame([(bytearray(a.astype(np.int64).tobytes()), bytearray(n.astype(np.int64).tobytes())) for a, n in rows], ngram_join.OFTEN).repartition(12)
    every = sorted((-n, a) for x, y in rows for a, n in zip(x.tolist(), y.tolist(), strict=True))
    for most in (7, 300, 5_000):
        assert ngram_join.most_frequent(often, most).tolist() == sorted(a for _, a in every[:most])
    assert not len(ngram_join.most_frequent(often.limit(0), 5))


def test_overlaps():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 80)).astype(np.uint64)) for _ in range(40)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    got = ngram_join.overlaps(sets)
    assert all(got[i][j] == want[i][j] for i in range(40) for j in range(40) if i != j)


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances_together(monkeypatch):
    """Pairs that are compared together, in bands of one and more words, have the verdicts of single ones."""
    rng = random.Random(17)
    pairs, want = [], []
    for k in range(600):
        alphabet = "ab" if k % 3 == 0 else "".join(map(chr, range(0x4E00, 0x4E00 + 400))) if k % 7 == 0 else "abcdefgh "
        a = "".join(rng.choice(alphabet) for _ in range(rng.choice((1, 20, 64, 65, 130, 700))))
        b = list(a)
        for _ in range(rng.randrange(1 + len(a) // 6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(alphabet) * rng.randrange(2)
        a, b = sorted((a, "".join(b)), key=len)
        most = rng.choice((len(b) // 10, len(b) // 7, 1))
        pairs.append((*(np.frombuffer(x.encode("utf-32-le"), "<u4") for x in (a, b)), most))
        want.append(line_dedup.edit_distance(a, b, most) <= most)
    assert line_dedup.all_within(pairs).tolist() == want and any(want) and not all(want)
    monkeypatch.setattr(line_dedup, "TOGETHER_BITS", 1 << 12)
    assert line_dedup.all_within(pairs).tolist() == want


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(12)))
        b = "".join(rng.choice("abé") for _ in range(rng.randrange(12)))
        d, most = plain_distance(a, b), rng.randrange(12)
        assert (line_dedup.edit_distance(a, b, most) == d) if d <= most else line_dedup.edit_distance(a, b, most) > most
    assert line_dedup.similar("x" * 100, "x" * 90) and not line_dedup.similar("x" * 100, "x" * 89)


def brute_lines(rows):
    """What stays of each document, with the definition taken literally: all pairs of lines by edit similarity, the first occurrence of a group."""
    entries, occurrences = {}, []
    for d, t in sorted(rows):
        for k, line in enumerate(t.split("\n")):
            if len(re.findall(rb"[^\x20\x09-\x0d]+", line.encode())) >= line_dedup.MIN_WORDS:
                own = line_dedup.normalised(line)
                occurrences.append((d, k, own))
                entries.setdefault(own, len(entries))
    names = list(entries)
    edges = [(k, k) for k in range(len(names))]
    for x in range(len(names)):
        for y in range(x):
            if line_dedup.similar(names[x], names[y]):
                edges.append((x, y))
    roots = brute_components(edges)
    first, gone = {}, set()
    for d, k, own in occurrences:
        if first.setdefault(roots[entries[own]], (d, k)) != (d, k):
            gone.add((d, k))
    return {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}


@pytest.mark.parametrize("small", [False, True])
def test_lines(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(line_dedup, "UNIT_CHARS", 3000)
        monkeypatch.setattr(line_dedup, "UNIT_LINES", 6)
        monkeypatch.setattr(line_dedup, "CELL_LINES", 40)
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("etaoinshr") for _ in range(6)) for _ in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice((6, 20, 60)))] for _ in range(25)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rng.randint(1, 6)):
            own = list(rng.choice(bases))
            if rng.random() < 0.5:
                own[rng.randrange(len(own))] += "x"
            lines.append(rng.choice(("  ", " ", "\t")).join(w.upper() if rng.random() < 0.05 else w for w in own))
        rows.append((d, "\n".join([*lines, "short line", ""])))
    got = line_dedup.dedup_lines(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "root", "n", "rep"]
    want, got = brute_lines(rows), {r.doc_id: r.text for r in got.collect()}
    # Where cells are split, a sample of bits may part a pair.
    assert sum(got[d] != want[d] for d in want) <= (3 if small else 0)


def test_lines_other_cases(spark):
    line = "these are five words here"
    rows = [(2, line), (1, f"{line}\n\n{line.upper()}"), (3, None), (None, line), (4, ""), (5, "a\n\nb"), (1, "other text of some words\n" + line)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()), key=str)
    kept = [t for _, d, t in got if t and line in t]
    assert len(got) == len(rows) and len(kept) == 1 and (False, 2, "") in got and (False, 3, None) in got and (True, 0, "") in got and (False, 5, "a\n\nb") in got
    assert line_dedup.dedup_lines(docs(spark, [])).collect() == []
    names = ["gone", "a.b", "row_hash", "line", "node", "c0", "Text`s"]
    frame = spark.createDataFrame([(k, line, *map(str, range(len(names)))) for k in (4, 2, 2)], ["doc_id", "text", *names])
    out = line_dedup.dedup_lines(frame)
    assert out.columns == frame.columns and sorted(map(tuple, out.collect())) == [(2, line, *map(str, range(7)))] * 2 + [(4, "", *map(str, range(7)))]


def test_very_long_lines(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoin") for _ in range(rng.randint(2, 9))) for _ in range(30_000)]
    other = list(words)
    other[17], other[20_000] = "changed", "too"
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, [(1, " ".join(words)), (2, " ".join(other)), (3, "x" * 200_000), (4, " ".join(words[::-1]))])).collect()}
    assert got[1] and got[2] == "" and got[3] == "x" * 200_000 and got[4]


def thue_morse(n):
    return [k.bit_count() & 1 for k in range(n)]


def test_lines_whose_words_are_made_to_collide():
    """Lines of 2,048 words in Thue-Morse order and its complement have equal hashes by any polynomial modulo a power of two."""
    import pyarrow as pa

    lines = [" ".join("ab"[k ^ flip] for k in thue_morse(2048)) for flip in (0, 1)]
    planes = line_dedup.Planes.of(np.zeros(line_dedup.DIMS**2, np.int64), np.zeros(line_dedup.DIMS + 1, np.int64))
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([1, 2, 3]), pa.array([*lines, lines[0]])], names=["doc_id", "row_hash", "text"])
    a, b, c = ((r["hash_a"], r["hash_b"]) for x in line_dedup._line_rows(iter([rows]), planes) for r in x.to_pylist())
    assert a == c != b


def test_blocks(monkeypatch):
    """Fingerprints that differ in fewer bits than there are blocks meet, whatever the cell's size."""
    monkeypatch.setattr(line_dedup, "SMALL_CELL", 2)
    rng = np.random.default_rng(5)
    for n in (40, 3000):
        width = min(16, max(8, n.bit_length() - 3))
        bits = rng.integers(0, 1 << 63, (n, line_dedup.BITS // 64), dtype=np.uint64)
        bits[1::2] = bits[::2]
        for k in range(1, n, 2):
            for bit in rng.choice(line_dedup.BITS, line_dedup.BITS // width - 1, replace=False).tolist():
                bits[k, bit >> 6] ^= np.uint64(1 << (bit & 63))
        label = line_dedup.near_forest(np.full(n, 50), bits, np.zeros((n, line_dedup.CLASSES), np.uint8))
        assert (label == np.arange(n) // 2 * 2).all()
        monkeypatch.setattr(line_dedup, "LONG_RUN", 0)
        assert len(set(line_dedup.near_forest(np.full(n, 50), bits, np.zeros((n, line_dedup.CLASSES), np.uint8)).tolist())) < n // 2
        monkeypatch.undo()
        monkeypatch.setattr(line_dedup, "SMALL_CELL", 2)


def test_leaks(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.randint(12, 60))) for k in range(30)]

    def edited(t, share):
        words = t.split()
        for _ in range(int(share * len(words))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words)

    rows, planted = [], set()
    for d in range(200):
        if d % 4 == 0:
            k = rng.randrange(30)
            share = rng.choice((0, 0, 0.1))
            rows.append((d, f"{text(100)}\n{edited(items[k][1], share).upper()} {text(50)}"))
            planted.add((d, k))
        else:
            rows.append((d, text(rng.randint(0, 300))))
    bench = spark.createDataFrame([*items, (99, None), (98, ""), (97, "too short")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs(spark, rows), bench).collect()}
    assert found <= planted and len(found) >= 0.96 * len(planted)
    in_blocks = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs(spark, rows), bench, block_chars=2000).collect()}
    assert in_blocks == found
    clean = decontamination.without_leaks(docs(spark, [*rows, (None, None)]), bench)
    assert clean.columns == ["doc_id", "text", "root", "n", "rep"] and {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in found} | {None}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(docs(spark, rows), empty).collect() == [] == decontamination.leaks(docs(spark, []), bench).collect()


def test_nearest():
    rng = random.Random(2)
    for _ in range(200):
        p = "".join(rng.choice("abé") for _ in range(rng.choice((1, 2, 7, 64, 65))))
        t = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 14)))
        assert decontamination.nearest(p, t) == min(plain_distance(p, t[a:b]) for a in range(len(t) + 1) for b in range(a, len(t) + 1))


def test_embedding_follows_edits():
    rng = random.Random(4)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(200))
    near = base[:100] + b"x" + base[100:]
    far = bytes(rng.choice(b"abcdefgh") for _ in range(200))
    a, b, c = (decontamination.walk(np.frombuffer(x, np.uint8), np.zeros(1), 390, 1)[:, 0] for x in (base, near, far))
    assert (a != b).mean() < 0.3 < (a != c).mean()


def edited_text(rng, text, kind, vocabulary):
    if kind == "words":
        words = text.split()
        for k in rng.sample(range(len(words)), max(1, len(words) // 7)):
            words[k] = rng.choice(vocabulary)
        return " ".join(words)
    if kind == "every third word":
        words = text.split()
        for k in range(2, len(words), 3):
            letters = list(words[k])
            for j in rng.sample(range(len(letters)), max(1, int(0.6 * len(letters)))):
                letters[j] = rng.choice("etaoinshrdlucm")
            words[k] = "".join(letters)
        return " ".join(words)
    letters = list(text)
    for j in rng.sample(range(len(letters)), int({"letters 0.1": 0.1, "letters 0.15": 0.15, "letters 0.2": 0.2}[kind] * len(letters))):
        letters[j] = rng.choice(("", rng.choice("etaoinshrdlucm"), rng.choice("etaoinshrdlucm"), letters[j] + rng.choice("etaoinshrdlucm")))
    return "".join(letters)


@pytest.mark.parametrize("words", [(5, 8), (9, 14), (15, 30), (31, 60)])
def test_recall_of_leaks(words):
    """All items against all texts by exact edit similarity, and what the bands find of it, for each kind of edit."""
    import pyarrow as pa

    rng = random.Random(words[0])
    vocabulary = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(rng.randint(*words)) for _ in range(120)]
    kinds = ("letters 0.1", "letters 0.15", "letters 0.2", "words", "every third word", None)
    rows, kind = [], []
    for k in range(600):
        kind.append((kinds[k % 6], rng.randrange(120)))
        rows.append(text(40) if kind[-1][0] is None else f"{text(20)} {edited_text(rng, items[kind[-1][1]], kind[-1][0], vocabulary)} {text(20)}")
    found = {(r, i) for r, i, _, _ in decontamination.find_leaks(pa.array(rows), decontamination.Benchmark.of(list(enumerate(items))))}
    want = {(r, i) for r, (name, i) in enumerate(kind) if name and decontamination.nearest(items[i], rows[r]) <= int(0.2 * len(items[i]) + 1e-9)}
    total, hit = collections.Counter(kind[r][0] for r, _ in want), collections.Counter(kind[r][0] for r, _ in want & found)
    print(words, {k: f"{hit[k]}/{total[k]}" for k in total})
    for r, i in found - want:
        assert decontamination.nearest(items[i], rows[r]) <= int(0.2 * len(items[i]) + 1e-9)
    assert hit.total() >= 0.95 * total.total() and all(hit[k] >= 0.9 * total[k] for k in total if total[k] >= 20)


def test_leaks_other_cases(spark):
    item = "the quick brown fox jumps over the lazy dog and runs away from all of the hounds"
    bench = spark.createDataFrame([(1, item), (1, "second text of the first item which is long enough"), (None, "日本語の文章には空白がないので単語の境界がわかりません、しかし検出できます"), (2, "  "), (3, None), (4, "tiny")], "item_id long, text string")
    rows = [(1, f"x {item.upper()} y"), (1, f"x {item.upper()} y"), (2, "前置きの文です。日本語の文章には空白がないので単語の境界が分かりません、しかし検出できます。続きの文です。"), (3, None), (4, ""), (5, " \n "), (None, "a " * 200_000 + item), (6, "x" * 300_000)]
    got = sorted((r.doc_id or 0, r.item_id or 0, round(r.similarity, 2), r.start_word, r.n_words) for r in decontamination.leaks(docs(spark, rows), bench).collect())
    assert got == [(0, 1, 1.0, 200_000, 17), (1, 1, 1.0, 1, 17), (1, 1, 1.0, 1, 17), (2, 0, got[-1][2], 0, 1)] and got[-1][2] > 0.9
    frame = spark.createDataFrame([(k, t, "z", "z", "z") for k, t in rows], "doc_id long, text string, `a.b` string, bit string, c0 string")
    clean = decontamination.without_leaks(frame, bench)
    assert clean.columns == frame.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6]


@pytest.mark.parametrize("words", [3, 8, 15, 27, 60, 120])
def test_recall_of_similar_lines(spark, words):
    """Of pairs with edit similarity 0.9 or more, whatever their fingerprints, one line goes: recall for each kind of edit."""
    rng = random.Random(words)
    vocabulary = ["".join(rng.choice("etaoinshrdlucm") for _ in range(rng.randint(2, 9))) for _ in range(2000)]
    rows, kind = [], {}
    for k in range(400):
        own = [rng.choice(vocabulary) for _ in range(words)]
        line, name = " ".join(own), ("letter", "word", "scattered", "boundary")[k % 4]
        if name == "word":
            own[rng.randrange(words)] = rng.choice([w for w in vocabulary if len(w) <= 4])
            other = " ".join(own)
        else:
            letters = list(line)
            for j in rng.sample(range(len(line)), max(1, int({"letter": 0, "scattered": 0.05, "boundary": 0.1}[name] * len(line)))):
                letters[j] = rng.choice(("", rng.choice("etaoinshrdlucm"), letters[j] + rng.choice("etaoinshrdlucm")))
            other = "".join(letters)
        if line_dedup.normalised(line) != line_dedup.normalised(other) and len(other.split()) >= line_dedup.MIN_WORDS and line_dedup.similar(line, line_dedup.normalised(other)):
            rows += [(2 * k, line), (2 * k + 1, other)]
            kind[2 * k + 1] = name
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    found = collections.Counter(kind[d] for d in kind if got[d] == "")
    total = collections.Counter(kind.values())
    print(words, {x: f"{found[x]}/{total[x]}" for x in total})
    assert sum(got[d] != t for d, t in rows if d not in kind) <= 2
    assert found.total() >= 0.9 * total.total() and found["letter"] >= 0.97 * total["letter"] and found["word"] >= 0.9 * total["word"]


def test_diagonals():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randrange(14))) for _ in range(2))
        d, most = plain_distance(a, b), rng.randrange(10)
        assert line_dedup.few_edits(a, b, most) == (d if d <= most else None)


def test_leaks_by_portions_of_places(monkeypatch):
    """A walk goes on over the end of a portion of places: portions of any size give the same candidates."""
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinsü") for _ in range(rng.randint(1, 22))) for _ in range(90)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((2, 4, 9, 20, 40) * 3)]
    texts = [" ".join([*rng.choices(words, k=9), items[rng.randrange(15)][1], *rng.choices(words, k=5)]) for _ in range(60)]
    bench = decontamination.Benchmark.of(items)
    (_, _, found), = decontamination.wk.scan_column(decontamination.pa.array(texts))
    chars = decontamination.Chars.of(found)
    want = [x.tolist() for x in decontamination.candidates(chars, bench)]
    assert len(want[0]) >= 60
    for size in (1, 7, 100):
        monkeypatch.setattr(decontamination, "PLACES", size)
        assert [x.tolist() for x in decontamination.candidates(chars, bench)] == want


def steps_together(plan):
    """How many Arrow functions a stage of a plan has one on top of the other, at most: each takes a worker of its own in every task."""
    path, most = [], 0
    for line in plan.splitlines():
        found = re.match(r"[ :+\-]*(?:\*\(\d+\) )?(\w+)", line)
        if not found:
            continue
        while path and path[-1][0] >= found.start(1):
            path.pop()
        before = path[-1][1] if path else 0
        path.append((found.start(1), 0 if found[1].endswith("Exchange") else before + (found[1] == "MapInArrow")))
        most = max(most, path[-1][1])
    return most


def test_no_stage_has_two_arrow_functions_in_a_row(spark, monkeypatch):
    """An executor keeps the workers of its busiest stage, and takes them by turns: two for each task would hold twice the memory ever after."""
    plans = []

    def noting(function):
        def run(df, *rest):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
            return function(df, *rest)

        return run

    for module in (components, line_dedup, ngram_join, units):
        monkeypatch.setattr(module, "staged", noting(common.staged))
    for name in ("first", "collect"):
        monkeypatch.setattr(type(spark.range(1)), name, noting(getattr(type(spark.range(1)), name)))
    rows = corpus(8, groups=4)
    # Tables as small as these would be broadcast.
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert joined(spark, rows) == brute_join(rows)
    line_dedup.dedup_lines(docs(spark, [(k, t) for k, t in rows if t])).collect()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(plans) > 20 and any("MapInArrow" in x for x in plans)
    assert not [x for x in plans if steps_together(x) > 1]


def test_windows_are_compared_in_little_memory():
    """A portion of windows takes little beside its letters' places, and gives each window its own distance."""
    rng = np.random.default_rng(4)
    items = [decontamination.Item(k, x, x.astype("<u4"), 60, 80) for k, x in enumerate(rng.integers(97, 123, (4, 400)).astype(np.uint8))]
    low = rng.integers(97, 123, 200_000).astype(np.uint8)
    item, begin = rng.integers(0, 4, 4_096), rng.integers(0, 199_000, 4_096)
    end = begin + rng.integers(300, 500, 4_096)
    low[begin[7] : begin[7] + 400] = items[item[7]].low
    tracemalloc.start()
    (some, best, where), = decontamination._compared(low, items, item, begin, np.maximum(end, begin + 400))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    k = some.tolist().index(7)
    assert best[k] == 0 and where[k] == 400 and peak < 28 << 20
    for k in (0, 1_000, 4_095):
        a, b = begin[some[k]], max(end[some[k]], begin[some[k]] + 400)
        assert best[k] == decontamination.nearest(items[item[some[k]]].low.tobytes().decode(), low[a:b].tobytes().decode())


def test_lines_by_stretches_of_any_size(monkeypatch):
    """Lines are worked on in stretches that fit the processor's cache; their size changes neither moments nor rows, nor do portions of pairs the clusters."""
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinsü") for _ in range(rng.randint(1, 12))) for _ in range(400)]
    texts = ["\n".join(" ".join(rng.choices(words, k=rng.randint(2, 60))) for _ in range(60)) for _ in range(40)]
    batch = line_dedup.pa.RecordBatch.from_arrays([line_dedup.pa.array(range(40)), line_dedup.pa.array(range(40)), line_dedup.pa.array(texts)], names=["doc_id", "row_hash", "text"])
    (_, _, found), = line_dedup.wk.scan_column(batch.column(2))
    lines = line_dedup.normalised_lines(found)
    assert all(lines.end[x.stop - 1] - lines.start[x.start] <= 1 << 17 for x in line_dedup._stretches(lines))

    def results():
        (sums,) = line_dedup._moments(iter([batch.select(["text"])]))
        product, total = (np.frombuffer(sums.column(k)[0].as_py(), np.int64) for k in (0, 1))
        rows = line_dedup.pa.Table.from_batches(line_dedup._line_rows(iter([batch]), line_dedup.Planes.of(product, total))).to_pydict()
        bits, bag = (np.frombuffer(b"".join(rows[k]), t).reshape(len(rows[k]), -1) for k, t in (("bits", np.uint64), ("bag", np.uint8)))
        return product.tolist(), rows, line_dedup.near_forest(np.array(rows["n_chars"]), bits, bag).tolist()

    want = results()
    assert len(want[1]["line"]) > 2_000
    for size in (1, 5_000, 1 << 20):
        monkeypatch.setattr(line_dedup, "STRETCH_BYTES", size)
        monkeypatch.setattr(line_dedup, "JUDGED", max(300, size // 100))
        got = results()
        assert got[0] == want[0] and {k: v for k, v in got[1].items() if k != "bits"} == {k: v for k, v in want[1].items() if k != "bits"}
        # Single precision rounds by the matrix' shape: a sign at zero may turn.
        assert sum(x != y for x, y in zip(got[1]["bits"], want[1]["bits"], strict=True)) <= 2
        assert size == 1 or got[2] == want[2]
