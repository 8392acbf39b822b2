"""The operators on documents against brute force, on tables with awkward rows."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from tests.llm.helpers import awkward_rows, documents, prose, with_clashes

from seqwatch.llm import bpe, classifier, components, decontaminate, jaccard, langid, quality_rules, sharding, token_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).repartition(3).cache()


def test_shards_are_contiguous_and_even(spark, docs):
    many = documents(spark, [(i, prose(20 + i % 7, i), "en", "s", 1) for i in range(400)])
    rows = sharding.contiguous_shards(many, 10).collect()
    totals = Counter()
    for r in rows:
        totals[r["shard"]] += r["size"]
        assert r["size"] == len(prose(20 + r["doc_id"] % 7, r["doc_id"]).encode()) + 16
        assert r["text_crc32"] == zlib.crc32(prose(20 + r["doc_id"] % 7, r["doc_id"]).encode())
    assert max(totals.values()) - min(totals.values()) <= 2 * max(r["size"] for r in rows)
    rows.sort(key=lambda r: r["doc_id"])
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    for s in range(10):
        assert [r["slot"] for r in rows if r["shard"] == s] == list(range(sum(r["shard"] == s for r in rows)))


@pytest.mark.parametrize("clash", [False, True])
def test_shards_of_awkward_rows(spark, docs, clash):
    rows = sharding.contiguous_shards(with_clashes(docs) if clash else docs, 5).collect()
    expected = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in awkward_rows() if i)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"]) == expected
    assert len(rows) == len(awkward_rows()) and {r["law"] for r in rows} == {"bytes"}


def test_empty_tables(spark):
    none = documents(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    assert sharding.contiguous_shards(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert jaccard.jaccard_groups(none).count() == 0
    assert jaccard.one_of_each(none).count() == 0
    assert decontaminate.find_leaks(none, items).count() == 0
    assert token_files.token_files(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert bpe.encode_documents(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).count() == 0
    assert langid.fit(langid.training_rows(none)) is None and langid.identify(none, None).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = classifier.fit(classifier.training_rows(none, labels))
    assert model is None and classifier.score(none, model).count() == 0


def test_byte_bpe_equals_the_library(spark, docs):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path)[0], special_tokens={})
    rows = bpe.encode_documents(with_clashes(docs), path, public_tokenizers.PATTERN).collect()
    found = Counter((r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in rows)
    assert found == Counter((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in awkward_rows())


def test_long_pieces_merge_like_the_library():
    import tiktoken

    ranks, _ = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for piece in ("a" * 4097, "abab" * 500, "é" * 333, "zqx" * 77, "\x00\x01"):
        assert bpe.merge_piece(piece.encode(), ranks) == library.encode_ordinary(piece)


def test_pieces_merged_together_equal_those_merged_alone(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks, _ = bpe.load_ranks(path)
    draw = random.Random(4)
    letters = ["ab", "etaoin shrdlu", "éßжあ🙂x", "".join(map(chr, range(32, 127)))]
    pieces = ["".join(draw.choices(draw.choice(letters), k=draw.randint(2, 64))).encode()[: draw.randint(2, 64)] for _ in range(3000)]
    pieces = [p for p in pieces if p not in ranks]
    monkeypatch.setattr(bpe, "LEAVES", 512)
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.merge_together(pieces, path)] == [bpe.merge_piece(p, ranks) for p in pieces]


def test_texts_keep_their_ids_when_few_pieces_are_remembered(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    texts = [None, "", *(prose(50, k) + " qwx" * k + " " + "zq" * 90 for k in range(20)), "one", None]
    whole = bpe.Codec(path, public_tokenizers.PATTERN).encode_all(texts)
    for remembered, chars in ((5, 300), (300, 1), (0, 1 << 20)):
        monkeypatch.setattr(bpe, "REMEMBERED", remembered)
        monkeypatch.setattr(bpe, "CHARS", chars)
        codec = bpe.Codec(path, public_tokenizers.PATTERN)
        assert codec.encode_all(texts) == whole and len(codec.known) <= remembered
    assert [codec.encode(t) for t in texts] == whole


def test_only_pieces_that_are_no_tokens_are_remembered():
    codec = bpe.Codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    codec.encode_all([prose(400, 1), "the of and " * 20])
    assert codec.known and not any(piece.encode() in codec.ranks for piece in codec.known)


def test_token_files_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = token_files.token_files(with_clashes(docs), path).collect()
    expected = Counter((i, tuple(library.encode(t or "", add_special_tokens=False).ids + [2])) for i, t, *_ in awkward_rows())
    assert Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows) == expected
    rows.sort(key=lambda r: r["start"])
    assert [r["start"] for r in rows] == list(np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1])
    assert [r["doc_id"] for r in rows if r["doc_id"]] == sorted(r["doc_id"] for r in rows if r["doc_id"])


def test_codec_of_all_widths():
    draw = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1001):
        x = (draw.integers(0, 1 << 32, n, dtype=np.uint64) >> draw.integers(0, 32, n, dtype=np.uint64)).astype(np.uint32)
        assert (token_files.unpack(*token_files.pack(x), n) == x).all()


def test_words_with_marks_equal_the_library():
    words = token_files.encoder(public_tokenizers.path("word_bpe_49k.json"))
    for t in ("don't. it's! ''s ...", "<|endoftext|>, a", "Σας İ é́. 😀, ½. a1!", "a\x1cb c\x85", "ÀÉ.\n\n###%%% x&&&"):
        assert np.frombuffer(words.encode(t), words.dtype).tolist() == words.tokenizer.encode(t, add_special_tokens=False).ids


def test_random_texts_equal_the_library():
    words = token_files.encoder(public_tokenizers.path("word_bpe_49k.json"))
    draw = random.Random(4)
    parts = [*"abcgAZÅéßÉİıſﬁΣς<>|!?.,;:'\"()[]#$%&*+-/=@^_`~\\0123456789 \t\n\r\x1c\x85\u200b\u0301\u0308漢😀½²", "at", "hello", "<|", "|>", "endoftext", "  ", "don't", "\u0130<"]
    parts += [t.content for t in words.tokenizer.get_added_tokens_decoder().values()]
    texts = ["at<", "hello<", "Å<", "İ:;"] + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 14))) for _ in range(50_000)]
    for t, e in zip(texts, words.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(words.encode(t), words.dtype).tolist() == e.ids, t


def brute_groups(rows):
    sets = []
    for _, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids) if ids else None))
    return Counter(out)


def near_rows():
    rows = awkward_rows()
    for group in range(6):
        base = prose(60 + 37 * group, 100 + group).split()
        for k in range(25):  # near copies around a base, some under the similarity, some linked by others only
            w = list(base)
            for e in range(k % 5):
                w[(k * 7 + e * 23) % len(w)] = f"edit{k}x{e}"
            rows.append((1000 + group * 100 + k, " ".join(w), "en", "s", 1))
    passage = prose(55, 999)
    rows += [(5000 + k, prose(20 + 5 * (k % 9), 5000 + k) + "\n" + passage, "en", "s", 1) for k in range(150)]
    return rows


def test_jaccard_groups_equal_brute_force(spark):
    rows = near_rows()
    found = jaccard.jaccard_groups(with_clashes(documents(spark, rows).repartition(5)))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == brute_groups(rows)


def test_jaccard_in_chunks_and_by_many_pivots(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 10)
    monkeypatch.setattr(jaccard, "PIVOT_ROWS", 7)
    monkeypatch.setattr(jaccard, "COUNTED_ROWS", 50)
    monkeypatch.setattr(jaccard, "HELD_THIN", 64)
    rows = near_rows()
    found = jaccard.jaccard_groups(documents(spark, rows).repartition(5))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()) == brute_groups(rows)


def test_parities_of_many_pairs_take_little_memory():
    import tracemalloc

    draw = np.random.default_rng(2)
    bits = jaccard.Parities([draw.bytes(1024) for _ in range(64)])
    i, j = (draw.integers(0, 64, 1 << 15) for _ in range(2))
    tracemalloc.start()
    odd = bits.odd(i, j)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24 << 20
    whole = bits.tables[128]
    assert odd[:50].tolist() == [int(np.bitwise_count(whole[bits.place[a]] ^ whole[bits.place[b]]).sum()) for a, b in zip(i[:50], j[:50])]


def test_count_tree_finds_all_within_the_bounds():
    draw = np.random.default_rng(1)
    points = draw.poisson(4, (700, jaccard.COARSE)).astype(np.int32)
    points[350:] = points[:350] + draw.integers(0, 2, (350, jaccard.COARSE))
    sizes, cell = points.sum(1), np.tile(draw.integers(0, 9, 350) ** 2, 2)
    reach = sizes - draw.integers(0, 20, 700)
    tree = jaccard.CountTree(cell, points, sizes, reach)
    q, at = tree.pairs(np.arange(700), 80)
    found = {frozenset((tree.order[i], tree.order[j])) for i, j in zip(q, at)}
    expected = set()
    for i, j in combinations(range(700), 2):
        bound = min(np.minimum(points[i], points[j]).sum(), reach[i], reach[j])
        if cell[i] == cell[j] and jaccard.may_link(bound, sizes[i], sizes[j]):
            expected.add(frozenset((i, j)))
    assert expected <= found and len(expected) > 50
    assert all(cell[i] == cell[j] for i, j in map(tuple, found)) and len(found) == len(q)


def test_cell_pairs_join_all_components():
    draw = np.random.default_rng(8)
    sets = [np.unique(draw.integers(0, 1 << 63, 40).astype(np.uint64)) for _ in range(20)]
    sets = [np.unique(np.concatenate([s[: 40 - k % 3], draw.integers(0, 1 << 63, k % 3).astype(np.uint64)])) for s in sets for k in range(12)]
    cell = np.repeat(np.arange(4), 60)
    points, sizes = np.array([jaccard.counts(s, jaccard.COARSE) for s in sets], np.int32), np.array([len(s) for s in sets])
    fine, comps = [jaccard.parities(s) for s in sets], np.arange(240)
    linked = lambda i, j: 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))
    expected = {frozenset(p) for p in combinations(range(240), 2) if cell[p[0]] == cell[p[1]] and linked(*p)}
    i, j, less = jaccard.cell_pairs(cell, points, sizes, sizes, comps, fine, 80, False)
    assert expected <= {frozenset(p) for p in zip(i.tolist(), j.tolist())} and not len(less)
    i, j, less = jaccard.cell_pairs(cell, points, sizes, sizes, comps, fine, 80, True)
    assert len(i) < 240 and less.tolist() == [0, 1, 2, 3]
    root = list(range(240))
    for a, b in zip(i.tolist(), j.tolist()):
        root = [root[a] if r == root[b] else r for r in root]
    assert all(root[a] == root[b] for a, b in map(tuple, expected))


def test_only_points_of_several_rows_are_written_again(spark, monkeypatch):
    rows = [(k, prose(40, k), "en", "s", 1) for k in range(60)] + [(100 + k, prose(40, k), "en", "s", 1) for k in range(5)] + [(None, prose(40, 1), "en", "s", 1), (200, None, "en", "s", 1)]
    sizes = {}
    real = jaccard.written

    def noted(df, name):
        found = real(df, name)
        sizes.setdefault(name, []).append(found.count())
        return found

    monkeypatch.setattr(jaccard, "written", noted)
    found = jaccard.jaccard_groups(documents(spark, rows).repartition(3)).collect()
    assert sizes["jaccard-points"][0] < 10
    assert sorted((r["doc_id"] is None, r["doc_id"], r["component_id"]) for r in found if r["doc_id"] is not None) == sorted((False, k, k - 100 if 100 <= k < 200 else k) for k, *_ in rows if k is not None)
    assert [r["component_id"] for r in found if r["doc_id"] is None] == [1]


def test_common_shingles_are_found_however_dealt(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "COUNTED_ROWS", 50)
    shared = prose(6, 77)
    rows = [(k, prose(12, k) + (" . " + shared if k % 10 == 0 else ""), "en", "s", 1) for k in range(600)]
    tokens, n = jaccard.common_shingles(documents(spark, rows).repartition(3), 5)
    wanted = jaccard.shingle_set(shared, 5)
    assert np.isin(wanted, tokens).all() and (n[np.isin(tokens, wanted)] > 30).all()


def test_rows_that_repeat_an_id_go_with_their_own_groups(spark):
    base, alone, other = prose(80, 1), prose(70, 2), prose(60, 3)
    near = " ".join(base.split()[:-1])
    rows = [(3, base), (7, near), (7, alone), (None, near), (None, other), (None, base + " x"), (9, alone), (9, alone), (None, prose(50, 4)), (None, prose(50, 4))]
    kept = jaccard.one_of_each(documents(spark, [(i, t, "en", "s", 1) for i, t in rows])).select("doc_id", "text").collect()
    assert Counter(map(tuple, kept)) == Counter([(3, base), (7, alone), (None, other), (None, prose(50, 4))])


def test_one_of_each_group_stays(spark):
    rows = near_rows()
    kept = jaccard.one_of_each(with_clashes(documents(spark, rows).repartition(3)))
    assert kept.first()["bits"] == "clash"
    groups = brute_groups(rows)
    ids = Counter(r["doc_id"] for r in kept.select("doc_id").collect() if r["doc_id"] is not None)
    empty = {i for i, n, _ in groups if n == 0}
    assert ids == Counter({c for _, n, c in groups if n and c is not None} | empty)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 99), (99, 99)], "a long, b long")
    found = {r["node"]: r["comp"] for r in components.components(edges).collect()}
    assert found == {**{k: 0 for k in range(61)}, 99: 99, 100: 99}


def test_quality_base_counts(spark, docs):
    def brute(t):
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len({*lines}), len(covered), failed

    rows = quality_rules.quality_rules(with_clashes(docs)).collect()
    found = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows)
    assert found == Counter((i, *brute(t)) for i, t, *_ in awkward_rows())
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_divergence_rejects_what_differs(spark):
    def text(seed):
        draw = np.random.default_rng(seed)
        return " ".join(draw.choice(["the", "of", "and", "to", "Rivers", "mountain.", "garden", "stone,"], 150).tolist() + [f"word{chr(97 + seed % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)])

    odd = [(900, " ".join(f"|{k}| %%%{k * 7919}$$$" for k in range(80)), "en", "s", 1), (901, "| 1 | 2 | 3 |" + " %% && " * 3 + "a b c d", "en", "s", 1)]
    rows = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(spark, [(k, text(k), "en", "s", 1) for k in range(40)] + odd)).collect()}
    assert all(rows[k]["kept"] for k in range(40))
    assert not rows[900]["kept"] and rows[900]["class_distance"] > 0.25
    assert rows[901]["kept"]  # too short to be judged


def test_only_the_word_rule_rejects(spark):
    def text(seed, common):
        draw = np.random.default_rng(seed)
        return " ".join(draw.choice([*common, "Rivers", "mountain.", "garden", "stone,"], 150).tolist() + [f"word{chr(97 + seed % 26)}{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)])

    rows = [(k, text(k, ["the", "of", "and", "to"]), "en", "s", 1) for k in range(40)]
    salad = [(900 + k, text(900 + k, ["hte", "fo", "nad", "ot"]), lang, "s", 1) for k, lang in enumerate(("en", None, "ru"))]
    found = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(spark, rows + salad)).collect()}
    assert all(found[k]["kept"] for k in range(40))
    for k in (900, 901):
        assert not found[k]["base_failed"] and found[k]["class_distance"] <= 0.25 and not found[k]["kept"]
    assert found[902]["kept"]  # no reference of its language
    unlisted = quality_rules.quality_rules(documents(spark, [(k, prose(120, k), "en", "s", 1) for k in range(20)])).collect()
    assert all(r["kept"] for r in unlisted)  # a reference without common words tells nothing


def test_js_distance(spark):
    from pyspark.sql import functions as F

    p, q = [0.5, 0.5, 0.0], [0.25, 0.25, 0.5]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a)
    row = spark.range(1).select(quality_rules.js_distance(F.array(*map(F.lit, p)), q).alias("d"), quality_rules.js_distance(F.array(*map(F.lit, p)), p).alias("z")).first()
    assert row["d"] == pytest.approx(np.sqrt((kl(p) + kl(q)) / 2)) and row["z"] == pytest.approx(0, abs=1e-7)


def sentences(lang, n, seed):
    words = {"en": "the of and to was with garden house".split(), "de": "der die und nicht garten haus über zwischen".split(), "ru": "и в не на сад дом река она".split()}[lang]
    return " ".join(np.random.default_rng(seed).choice(words, n).tolist())


def test_language_spans(spark):
    rows = [(k, sentences(("en", "de", "ru")[k % 3], 60, k), ("en", "de", "ru")[k % 3], "s", 1) for k in range(120)]
    model = langid.fit(langid.training_rows(documents(spark, rows)))
    assert model.languages == ["de", "en", "ru"]
    test = [(1, sentences("en", 30, 900) + " " + sentences("de", 50, 901), None, None, 1), (2, sentences("ru", 5, 902), None, None, 1), (3, "123 --", "en", "s", 1), *awkward_rows()]
    found = langid.identify(documents(spark, test).withColumnRenamed("n_chars", "score"), model).collect()
    assert len(found) == len(test)
    mixed = next(r for r in found if r["doc_id"] == 1 and r["text"] and r["lang"] is None)
    assert mixed["lang_pred"] == "de" and [s["lang"] for s in mixed["lang_spans"]] == ["en", "de"] and 0.5 < mixed["score"] < 0.8
    assert next(r for r in found if r["doc_id"] == 2 and r["text"])["lang_pred"] == "ru"
    for r in found:
        if not r["text"] or not re.search(r"[^\W\d_]", r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def test_viterbi_equals_enumeration():
    draw = np.random.default_rng(3)
    lengths = np.array([4, 0, 1, 6, 6, 2])
    scores = draw.normal(0, 3, (int(lengths.sum()), 3)).astype(np.float32)
    path = langid.viterbi(scores, lengths, 2.0)
    at = 0
    for n in lengths:
        s = scores[at : at + n]
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: E731, B023
        if n:
            best = max(value(p) for p in np.ndindex(*[3] * n))
            assert value(path[at : at + n].tolist()) == pytest.approx(best, abs=1e-4)
        at += n


def test_viterbi_of_long_texts_equals_the_exact_path():
    draw, n, switch = np.random.default_rng(6), 200_000, 8.0
    scores = draw.normal(-30, 6, (n, 2)).astype(np.float32)
    scores[np.arange(n), np.arange(n) // 37 % 2] += 1.5
    value, came = np.zeros(2, np.longdouble), np.zeros((n, 2), np.int64)
    for t in range(n):
        came[t] = np.where(value < value.max() - switch, value.argmax(), np.arange(2))
        value = np.maximum(value, value.max() - switch) + scores[t]
    path, now = np.zeros(n, np.int64), int(value.argmax())
    for t in range(n - 1, -1, -1):
        path[t], now = now, came[t, now]
    assert (langid.viterbi(scores, np.array([n]), switch) == path).all()


def test_classifier_learns_and_calibrates(spark):
    good = lambda k: prose(40, k).capitalize() + "."
    bad = lambda k: " | ".join(prose(25, k).split()) + " ### %%%"
    rows = [(k, bad(k) if k % 4 == 0 else good(k), "en", "s", 1) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(300)] + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows + awkward_rows())
    model = classifier.fit(classifier.training_rows(docs, labels))
    found = classifier.score(with_clashes(docs).drop("words"), model).select("doc_id", "text", "score").collect()
    assert len(found) == len(rows) + len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["doc_id"] and r["doc_id"] >= 20 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["score"] >= 0.5) == (r["doc_id"] % 4 != 0) for r in held]) > 0.95


def test_descent_reaches_the_dual_optimum():
    draw = np.random.default_rng(5)
    rows = [np.unique(draw.integers(0, 50, 12)).astype(np.int32) for _ in range(60)]
    labels = np.array([int(3 in x or 7 in x) for x in rows])
    ratios = classifier.log_count_ratios(rows, labels)
    w, b = classifier.descend(rows, labels, ratios, epochs=400)
    margin = np.array([w[x].sum() / np.sqrt(len(x)) + b for x in rows]) * np.where(labels, 1, -1)
    assert (margin > 0).mean() > 0.95


def test_descent_equals_the_optimum_by_projected_gradients():
    """The primal objective of the descent against that of the dense dual problem, solved by plain projected gradients."""
    draw = np.random.default_rng(11)
    rows = [np.unique(draw.integers(0, 30, 9)).astype(np.int32) for _ in range(50)]
    labels = np.array([int((3 in x) != (draw.random() < 0.2)) for x in rows])
    ratios = classifier.log_count_ratios(rows, labels)
    signs = np.where(labels, 1.0, -1.0)
    x = np.zeros((50, 31))
    for k, r in enumerate(rows):
        x[k, r], x[k, 30] = ratios[r] / np.sqrt(len(r)), 1.0
    limit = 0.5 / np.where(labels, labels.mean(), 1 - labels.mean())
    objective = lambda w: w @ w / 2 + limit @ np.maximum(0, 1 - signs * (x @ w))
    q = (signs[:, None] * x) @ (signs[:, None] * x).T
    alpha, step = np.zeros(50), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, limit)
    best = objective(x.T @ (signs * alpha))
    assert best - (alpha.sum() - alpha @ q @ alpha / 2) < 1e-6 * best  # no gap: this is the optimum
    found, bias = classifier.descend(rows, labels, ratios, epochs=2000)
    w = np.append(np.divide(found[:30], ratios[:30], out=np.zeros(30), where=ratios[:30] != 0), bias)
    assert objective(w) == pytest.approx(best, rel=2e-3) and objective(np.zeros(31)) > 1.05 * best


def test_leaks_are_found(spark):
    items = [(k, prose(15 + 3 * k, 700 + k)) for k in range(12)] + [(50, "only four words here"), (51, None), (52, ""), (53, prose(15, 700))]
    rows = awkward_rows()
    planted = {}
    for k in range(12):
        w = items[k][1].split()
        if k % 3 == 1:
            w[-1] = "changed"
        planted[2000 + k] = k
        rows.append((2000 + k, prose(50, k) + " " + " ".join(w).title() + ", " + prose(30, k), "en", "s", 1))
    rows.append((2100, "Only four, words here!", "en", "s", 1))
    rows.append((2101, " ".join(items[3][1].split()[:-6]), "en", "s", 1))
    found = decontaminate.find_leaks(with_clashes(documents(spark, rows)), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert got == {(d, k) for d, k in planted.items()} | {(2000, 53), (2100, 50)}
    r = next(r for r in found if r["doc_id"] == 2003)
    assert (r["start_word"], r["n_words"], r["similarity"]) == (50, 24, 1.0)
    clean = decontaminate.decontaminate(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert clean.columns == ["doc_id", "text", "lang", "source", "n_chars"] and clean.count() == len(rows) - 13


def test_leaks_equal_brute_force():
    items = [(k, prose(20 + k, 40 + k)) for k in range(8)]
    index = decontaminate.build_index(items)
    draw = np.random.default_rng(9)
    for k in range(60):
        item = int(draw.integers(8))
        w = items[item][1].split()
        for _ in range(int(draw.integers(3))):
            w[int(draw.integers(len(w)))] = "other"
        words = decontaminate.words_of(" ".join(prose(20, k).split() + w + prose(9, k).split()))
        n, hashes = int(index.sizes[item]), decontaminate.window_hashes(words, 5)
        best = max(index.similarity(item, hashes[s : s + n - 4]) for s in range(len(words) - n + 1))
        found = {i: v for i, _, _, v, _ in decontaminate.leaks(" ".join(prose(20, k).split() + w + prose(9, k).split()), index)}
        assert (item in found) == (best >= 0.8)
        if item in found:
            assert found[item] == pytest.approx(best)



def test_multi_index_finds_all_within_the_radius():
    items = [(k, prose(20, k)) for k in range(400)]
    index = decontaminate.build_index(items)
    draw = np.random.default_rng(2)
    prints = index.prints[draw.integers(0, 400, 300)].copy()
    bits = prints.view(np.uint8)
    for row in bits:  # up to 70 bits turned
        turned = draw.permutation(decontaminate.BITS)[: draw.integers(0, 70)]
        np.bitwise_xor.at(row, turned // 8, (1 << turned % 8).astype(np.uint8))
    distance = np.bitwise_count(prints[:, None] ^ index.prints[None]).sum(2)
    expected = {(w, i) for w, i in zip(*np.nonzero(distance <= decontaminate.RADIUS))}
    found = {*zip(*index.near(prints, {20}))}
    assert found == expected and len(expected) > 100


def test_leaks_do_not_depend_on_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(k, prose(15 + 3 * k, 700 + k)) for k in range(12)] + [(99, None)], "item_id long, text string")
    rows = [(k, prose(9, k) + " " + " ".join(prose(15 + 3 * k, 700 + k).split()[k % 3 :]) + " " + prose(9, k), "en", "s", 1) for k in range(12)] + awkward_rows()
    whole = sorted(map(tuple, decontaminate.find_leaks(documents(spark, rows), items).collect()))
    clean = decontaminate.decontaminate(documents(spark, rows), items).count()
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 3)
    assert sorted(map(tuple, decontaminate.find_leaks(documents(spark, rows), items).collect())) == whole and len(whole) == 11  # of 21 words without 2: 15 of 19 shingles
    assert decontaminate.decontaminate(with_clashes(documents(spark, rows)), items).count() == clean == len(awkward_rows()) + 1


def test_edge_edits_near_the_threshold_are_leaks():
    items = [(k, prose(30 + k % 30, 3000 + k)) for k in range(150)]
    index = decontaminate.build_index(items)
    near = 0
    for item, text in items:
        w = text.split()
        n, k = len(w), (len(w) - 4) // 9  # of n - 4 shingles k are lost and k new: similarity 0.8 or a little more
        for edited in (w[:-k] + [f"other{item}x{j}" for j in range(k)], [f"other{item}x{j}" for j in range(k)] + w[k:]):
            text = " ".join(prose(20, item).split() + edited + prose(9, item).split())
            best = index.similarity(item, decontaminate.window_hashes(decontaminate.words_of(" ".join(edited)), 5))
            found = {i for i, *_ in decontaminate.leaks(text, index)}
            assert item in found or best < 0.8
            near += 0.8 <= best < 0.85
    assert near > 150


def test_points_of_no_fitting_size_are_left_out(spark):
    rows = [("k", 1, 1, 100, True), ("k", 2, 2, 81, False), ("k", 3, 3, 300, True), ("k", 4, 4, 374, False), ("k", 5, 5, 1000, False), ("k", 6, 6, 1100, False), ("l", 7, 7, 90, True), ("l", 8, 7, 90, True), ("l", 9, 9, 200, True)]
    found = jaccard.sized(spark.createDataFrame(rows, "key string, sid long, comp long, n int, strong boolean"), 80)
    assert sorted(r["sid"] for r in found.collect()) == [1, 2, 3, 4]  # 5 and 6 are weak both; 7 and 8 one component


def test_pairs_are_told_by_their_first_cell():
    keys = [[5, 7, 9], [7, 9], [9, 5]]
    i, j = np.array([0, 0, 0, 0]), np.array([1, 1, 2, 2])
    assert [bool(jaccard.first_shared(keys, i[k : k + 1], j[k : k + 1], np.array([at] * 3))[0]) for k, at in enumerate((7, 9, 5, 9))] == [True, False, True, False]
