"""Filter audit, removal of repeats and collocations against brute force, on tables with awkward rows."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from tests.llm.helpers import awkward_rows, documents, prose, with_clashes

from seqwatch.llm import filter_audit, phrases, suffix_dedup
from seqwatch.llm.suffix_array import groups_and_previous, suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LABELS = "doc_id long, quality int, toxic int"


# filter audit


def audited(rows, labels):
    """Every order of the filters applied to every document, one after the other."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    found = Counter()
    for i, text, _, source, _ in rows:
        text, part = text or "", source or ""
        words = WORD.findall(text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if i is not None and i > first[text]:
            fails.add("E")
        good, toxic = any(q == 1 for d, q, _ in labels if d == i and i is not None), any(t == 1 for d, _, t in labels if d == i and i is not None)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, letter in enumerate(order, start=1):
                key = (part, order, step)
                failed = letter in fails
                now = failed and not gone
                for name, hit in (("removed", now), ("redundant", failed and gone), ("unique_fails", fails == {letter}), ("good_lost", now and good), ("toxic_lost", now and toxic)):
                    found[key, name] += hit
                gone |= failed
                found[key, "kept"] += not gone
                found[(part, letter), "shapley"] += now
    return found


def test_filter_audit_equals_every_order(spark):
    draw = random.Random(3)
    rows = [*awkward_rows(), (20, "WORD " * 300, None, None, 1), (21, prose(300, 4) + " 5 %", "en", "s", 1), (22, prose(300, 4) + " 5 %", "en", None, 1), (22, prose(300, 4) + " 5 %", "en", None, 1)]
    rows += [(30 + k, " ".join([prose(draw.choice([5, 150, 260]), k % 7), draw.choice(["", "#", "ABCDEFGH" * 9])]), "en", draw.choice(["s", "t", ""]), 1) for k in range(40)]
    labels = [(5, 1, 0), (6, 1, 1), (6, 0, None), (9, 1, 1), (20, 0, 1), (22, 1, None), (None, 1, 1), (31, 1, 1), (40, 1, 0), (999, 1, 1)]
    expected = audited(rows, labels)
    found = filter_audit.filter_audit(with_clashes(documents(spark, rows).repartition(3)), spark.createDataFrame(labels, LABELS)).collect()
    assert len(found) == 600 * len({r[3] or "" for r in rows})
    for r in found:
        key = (r["part"], r["filter_order"], r["step"])
        for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
            assert r[name] == expected[key, name], (key, name)
        assert r["shapley"] == expected[(r["part"], r["filter_order"][r["step"] - 1]), "shapley"]


def test_filter_audit_of_empty_tables(spark):
    assert filter_audit.filter_audit(documents(spark, []), spark.createDataFrame([], LABELS)).count() == 0
    found = filter_audit.filter_audit(documents(spark), spark.createDataFrame([], LABELS)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(found) == (0, 0)


def test_step_matrices_part_the_masks():
    steps, m = filter_audit.step_matrices()
    assert len(steps) == 600 and all(x.shape == (32, 600) for x in m.values())
    kept = np.concatenate([np.ones((32, 1), int), m["kept"]], axis=1)
    for k, (_, step, _) in enumerate(steps):
        before = np.ones(32, int) if step == 1 else kept[:, k]
        assert (before == m["kept"][:, k] + m["removed"][:, k]).all()


# removal of repeats


@pytest.mark.parametrize("letters", [1, 2, 3, 9])
def test_suffix_array_equals_sorting(letters):
    draw = random.Random(letters)
    for n in [*range(30), 200]:
        s = [draw.randrange(letters) for _ in range(n)]
        for x in (s, (s[:4] * n)[:n]):
            assert suffix_array(np.array(x, np.int64)).tolist() == sorted(range(len(x)), key=lambda i: x[i:])


def test_groups_are_lyndon_prefixes():
    s = [1, 0, 2, 0, 1, 0, 2, 0, 0, 3]
    begins, before = groups_and_previous(np.array(s))
    suffixes = [s[i:] for i in range(len(s))]
    assert before == [max((j for j in range(i) if suffixes[j] < suffixes[i]), default=-1) for i in range(len(s))]
    ends = [next((j for j in range(i + 1, len(s)) if suffixes[j] < suffixes[i]), len(s)) for i in range(len(s))]
    words = [tuple(s[i:e]) for i, e in enumerate(ends)]
    assert [begins[i] for i in range(len(s))] == [sum(w < words[i] for w in words) for i in range(len(s))]


def window_counts(texts, weights):
    found = Counter()
    for t, w in zip(texts, weights):
        for i in range(len(t) - 199):
            found[t[i : i + 200]] += w
    return found


@pytest.mark.parametrize("seed", range(6))
def test_repeated_windows_equal_brute_force(seed):
    draw = random.Random(seed)
    for _ in range(25):
        letters = draw.choice([1, 2, 4, 26])
        base = bytes(97 + draw.randrange(letters) for _ in range(draw.choice([300, 700, 1500])))
        pieces = []
        for _ in range(draw.randint(1, 12)):
            at = draw.randrange(len(base))
            piece = bytearray(base[at : at + draw.randint(1, 600)])
            for _ in range(draw.randint(0, 2)):
                piece[draw.randrange(len(piece))] = draw.randrange(97, 123)
            pieces.append(bytes(draw.randrange(97, 123) for _ in range(draw.randint(0, 80))) + bytes(piece))
        weights = [draw.choice([1, 1, 1, 3]) for _ in pieces]
        counts = window_counts(pieces, weights)
        expected = [[counts[p[i : i + 200]] > 1 for i in range(len(p) - 199)] for p in pieces]
        assert [x.tolist() for x in suffix_dedup.repeated_windows(pieces, weights)] == expected


def test_pieces_cover_each_window_once():
    for text in (prose(3000, 1), "x" * 10_000, "ab" * 300, "y" * 200, "y" * 199, ""):
        raw = np.frombuffer(text.encode(), np.uint8)
        keys, starts, counts, times = suffix_dedup.pieces_of(raw)
        assert counts.max(initial=0) <= suffix_dedup.MOST_WINDOWS and set(times) <= {1, 2}
        assert np.concatenate([[], *(np.arange(s, s + c) for s, c in zip(starts, counts))]).tolist() == list(range(max(len(raw) - 199, 0)))
        window_keys = dict()
        for key, s, c in zip(keys.tolist(), starts.tolist(), counts.tolist()):
            for i in range(s, s + c):
                assert window_keys.setdefault(text[i : i + 200], key) == key


def left_over(rows):
    texts = [(t or "").encode() for _, t, *_ in rows]
    counts = window_counts(texts, [1] * len(texts))
    for (i, *_), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 199):
            if counts[t[k : k + 200]] > 1:
                gone[k : k + 200] = True
        left = bytes(np.frombuffer(t, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        yield i, len(t), int(gone.sum()), runs, left, hashlib.sha256(left).hexdigest()


def shared_rows():
    draw = random.Random(5)
    passage, other = prose(60, 30), "é" * 150
    rows = [(50 + k, " ".join([prose(draw.randint(5, 60), 100 + k), passage[draw.randint(0, 30) : len(passage) - draw.randint(0, 150)], prose(8, k)]), "en", "s", 1) for k in range(30)]
    rows += [(90, other, "en", "s", 1), (91, "- " + other + " -", "en", "s", 1), (92, passage + passage, "en", "s", 1), (93, "z" * 5000, "en", "s", 1), (94, "abc" * 90, "en", "s", 1)]
    return [*awkward_rows(), *rows]


@pytest.mark.parametrize("most_of_key", [suffix_dedup.MOST_OF_KEY, 4])
def test_repeats_equal_brute_force(spark, most_of_key):
    rows = shared_rows()
    found = suffix_dedup.without_repeats(with_clashes(documents(spark, rows).repartition(5)), most_of_key).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["kept_sha256"]) for r in found)
    assert got == Counter(left_over(rows))


def test_small_batches_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 1)
    monkeypatch.setattr(suffix_dedup, "MOST_WINDOWS", 70)
    marks = suffix_dedup._marks
    piece = prose(80, 3).encode()

    class Batch:
        def __init__(self, rows):
            self.rows = rows

        def column(self, name):
            k = ("key", "piece", "digest", "weight").index(name)
            return type("Column", (), {"to_pylist": lambda _: [r[k] for r in self.rows]})()

    got = {}
    for out in marks([Batch([(1, piece, b"a", 1), (1, piece[:250], b"b", 1)]), Batch([(2, piece[:300], b"c", 1), (3, piece[:220], b"d", 2)])]):
        got |= dict(zip(out.column(0).to_pylist(), out.column(1).to_pylist()))
    bits = {k: np.unpackbits(np.frombuffer(v, np.uint8)).sum() for k, v in got.items()}
    assert bits == {b"a": 51, b"b": 51, b"d": 21}


def test_windows_of_one_large_key_take_bounded_memory():
    draw = random.Random(9)
    base = [prose(70, k).encode()[:290] for k in range(20)]
    pieces = []
    for k in range(3000):
        piece = bytearray(base[k % 20])
        piece[draw.randrange(len(piece))] = 97 + k % 26
        pieces.append(bytes(piece))
    tracemalloc.start()
    suffix_dedup.repeated_windows(pieces, [1] * len(pieces))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45 * sum(map(len, pieces))


def test_batches_hold_whole_keys_and_few_bytes():
    rows = [(k // 3, b"x" * 100, k) for k in range(30)] + [(99, b"x" * 700, 30), (99, b"x" * 700, 31), (100, b"x", 32)]
    batches = list(suffix_dedup.piece_batches(iter(rows), 1000))
    assert [r for b in batches for r in b] == rows
    assert len({(r[0], k) for k, b in enumerate(batches) for r in b}) == len({r[0] for r in rows})
    assert all(sum(len(r[1]) for r in b) <= 1000 or len({r[0] for r in b}) == 1 for b in batches)


def test_keys_with_many_bytes_are_dealt_by_windows(spark):
    rows = shared_rows()
    found = suffix_dedup.without_repeats(documents(spark, rows).repartition(5), most_bytes=1500).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["kept_sha256"]) for r in found)
    assert got == Counter(left_over(rows))


def test_a_crowded_key_falls_into_few_pieces():
    import pyarrow as pa

    draw = random.Random(4)
    base, texts = prose(70, 11)[:384], []
    for k in range(40):
        at = draw.randrange(150)
        texts.append(prose(20, 200 + k)[:at] + base + prose(20, 300 + k))
    found = [[{"key": 1, "start": 0, "windows": len(t.encode()) - 199, "hot": True}] for t in [*texts, "z" * 5000]]
    columns = [pa.array([b"%d" % k for k in range(len(found))]), pa.array([*texts, "z" * 5000]), pa.array([1] * len(found)), pa.array(found)]
    out = [r for b in suffix_dedup._long_keys([pa.RecordBatch.from_arrays(columns, names=["tid", "text", "copies", "found"])]) for r in b.to_pylist()]
    assert len(out) < sum(f[0]["windows"] for f in found) / 15
    key_of = {}
    for tid, text in enumerate([*texts, "z" * 5000]):
        own = [r for r in out if r["tid"] == b"%d" % tid]
        assert [i for r in own for i in range(r["start"], r["start"] + r["windows"])] == list(range(len(text) - 199))
        for r in own:
            for i in range(r["start"], r["start"] + r["windows"]):
                assert key_of.setdefault(text[i : i + 200], r["key"]) == r["key"]


@pytest.mark.parametrize("most_of_key", [1, 12, 30])
def test_near_copies_of_a_crowded_key_equal_brute_force(spark, most_of_key):
    draw = random.Random(8)
    base, rows = prose(80, 21), []
    for k in range(40):
        text = bytearray(base.encode())
        for _ in range(draw.randint(0, 2)):
            text[draw.randrange(len(text))] = 97 + draw.randrange(26)
        rows.append((k, prose(draw.randint(0, 9), 400 + k % 9) + text.decode() + prose(5, 500 + k % 3), "en", "s", 1))
    rows += [*rows[:5], (90, "z" * 900, "en", "s", 1), (91, "y" + "z" * 700, "en", "s", 1)]
    found = suffix_dedup.without_repeats(documents(spark, rows).repartition(5), most_of_key).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]), r["kept_sha256"]) for r in found)
    assert got == Counter(left_over(rows))


def test_repeats_of_empty_tables(spark):
    assert suffix_dedup.without_repeats(documents(spark, [])).count() == 0
    alone = suffix_dedup.without_repeats(documents(spark, [(1, prose(90, 1), "en", "s", 1)])).first()
    assert (alone["n_removed"], alone["n_spans"], bytes(alone["kept"]).decode()) == (0, 0, prose(90, 1))


# collocations


def counted(rows):
    counts, lengths = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            lengths[lang] += len(words)
            counts.update((lang, tuple(words[i : i + m])) for m in range(1, 5) for i in range(len(words) - m + 1))
    return counts, lengths


def ranked(rows, least, top):
    counts, lengths = counted(rows)
    out = []
    frequent = {k: f for k, f in counts.items() if f >= least and len(k[1]) > 1}
    for (lang, w), a in frequent.items():
        cuts = [(2_000_000 * a // (counts[lang, w[:k]] + counts[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        inside = any(l == lang and len(v) > len(w) and any(v[s : s + len(w)] == w for s in range(len(v))) and 100 * f >= 80 * a for (l, v), f in frequent.items())
        if not inside:
            out.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], lengths[lang], score))
    found = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        found += [(x[0], k, *x[1:]) for k, x in enumerate(mine, start=1)]
    return found


def phrase_rows():
    draw = random.Random(11)
    common = ["the", "of", "Ä\x01b", "ä", "nu", "x\x02", "end\x0b", "Now.", "so,", "a\tb"]
    rows = [(100 + k, " ".join(draw.choices([*common, f"w{k}"], weights=[9, 7, 5, 4, 3, 3, 1, 1, 1, 2, 1], k=draw.randint(0, 120))), draw.choice(["en", "de", None]), "s", 1) for k in range(60)]
    return [*awkward_rows(), *rows, *[(200 + k, "New York City is big. new york city is", "en", "s", 1) for k in range(20)]]


@pytest.mark.parametrize("tasks", ["4", "40"])
def test_collocations_equal_brute_force(spark, tasks):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", tasks)
    try:
        rows = phrase_rows()
        found = phrases.collocations(with_clashes(documents(spark, rows).repartition(3))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    got = sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in found)
    assert got == sorted(ranked(rows, 30, 2000)) and len(got) > 20


@pytest.mark.parametrize("batch_words", [phrases.BATCH_WORDS, 1])
def test_hot_words_are_dealt_by_longer_prefixes(monkeypatch, batch_words):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "BATCH_WORDS", batch_words)
    texts = ["the cat sat on the cat mat. the", "the cat sat"] * 40
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"] * 20, "text": texts[k : k + 20]}) for k in range(0, len(texts), 20)]
    for hot in ({}, {"en": {b"the"}}, {"en": {b"the", b"the cat"}}, {"en": {b"the", b"the cat", b"the cat sat"}}):
        lines = pa.Table.from_batches(phrases._lines(batches, hot)).sort_by("key").combine_chunks().to_batches()
        found = Counter()
        for out in phrases._counted(lines):
            for lang, phrase, words, f in zip(*(out.column(k).to_pylist() for k in range(4))):
                assert words == len(phrase.split())
                found[lang, tuple(phrase.split())] += f
        exact, _ = counted([(1, t, "en", "s", 1) for t in texts])
        assert found == Counter({k: f for k, f in exact.items() if f >= 30})


def test_heavy_prefixes_are_told():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["of the of the of the x y z, of a b c d e"]})
    (out,) = phrases._heavy([batch], 0.4)
    assert dict(zip(out.column(1).to_pylist(), out.column(2).to_pylist())) == {b"": 15, b"of": 4, b"the": 3, b"of the": 3}


def test_collocations_of_empty_tables(spark):
    assert phrases.collocations(documents(spark, [])).count() == 0
    assert phrases.collocations(documents(spark, [(1, None, "en", "s", 1), (2, "", None, "s", 1)])).count() == 0
