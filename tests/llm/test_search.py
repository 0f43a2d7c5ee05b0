"""Decontamination, near-dedup, suffix dedup and license scans against plain versions."""
import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from watchpost.llm import components, decontaminate, exact_dedup, licenses, near_copies, simhash, suffix_dedup

from .conftest import words


def plain_contamination(rows, bench, n):
    windows, sizes = defaultdict(set), set()
    for k, (ident, text) in enumerate(bench):
        w = words(text)
        for i in range(len(w) - min(n, len(w)) + 1 if w else 0):
            windows[tuple(w[i:i + min(n, len(w))])].add(ident)
            sizes.add(min(n, len(w)))
    out = Counter()
    for ident, text in rows:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if own := windows.get(tuple(w[i:i + size])):
                    found |= own
                    hit |= set(range(i, i + size))
        names = ",".join(sorted(str(x) for x in found if x is not None))
        out[ident, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)] += 1
    return out


@pytest.mark.parametrize("block", [1 << 20, 80])
@pytest.mark.parametrize("n", [10, 3])
def test_contamination(odd, rows, items, n, block):
    got = decontaminate.contamination(odd, items, n=n, block_bytes=block)
    want = plain_contamination(rows, [(r["item_id"], r["text"]) for r in items.collect()], n)
    assert Counter(tuple(r)[:6] for r in got.collect()) == want


def test_longest_match_and_removal(odd, items):
    long = items.where("item_id = 7")
    got = {r["doc_id"]: r for r in decontaminate.contamination(odd, long, n=10).collect() if r["contaminated"]}
    assert {k: (r["longest"], r["longest_at"], r["longest_item"]) for k, r in got.items()} == {9: (24, 1, "7"), 10: (24, 0, "7"), 16: (24, 361, "7")}
    kept = decontaminate.decontaminate(odd, long, n=10)
    assert kept.schema == odd.schema and kept.count() == odd.count() - 3


def test_suffix_array_sorts_runs():
    ids = np.array([3, 1, 3, 1, 3, -1, 1, 3, 1, -1, 2, -1])
    order, end = decontaminate.suffix_array(ids, 2)
    want = sorted([0, 1, 2, 3, 4, 6, 7, 8], key=lambda p: ids[p:end[p]].tolist())
    assert [ids[p:end[p]].tolist() for p in order] == [ids[p:end[p]].tolist() for p in want]


def plain_print(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(values, threshold=4):
    label = list(range(len(values)))
    near = np.bitwise_count(np.array(values, np.uint64)[:, None] ^ np.array(values, np.uint64)[None]) <= threshold
    while True:
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(values))]
        if new == label:
            return label
        label = new


def test_simhash(odd, rows):
    values = [plain_print(t) for _, t in rows]
    label = plain_components(values)
    least = {}
    for (i, _), g in zip(rows, label):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = Counter((i, f"{v:016x}", least.get(g)) for (i, _), v, g in zip(rows, values, label))
    assert Counter(tuple(r) for r in simhash.simhash_components(odd).collect()) == want


@pytest.mark.parametrize("scheme,tile", [(simhash.EXACT, 2048), (simhash.EXACT, 7), (simhash.EXACT_TWO, 2048)])
def test_anchors_lose_no_link(spark, scheme, tile):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64).view(np.uint64)
    values = [int(b) for b in base]
    for _ in range(6):  # chains of changes of up to six bits
        for b in base:
            flips = rng.choice(64, rng.integers(1, 7), replace=False)
            values.append(int(b) ^ sum(1 << int(x) for x in flips))
    values = sorted(set(values))
    nodes = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(n, v.to_bytes(8, "little")) for n, v in zip(nodes, values)], "node long, fp binary").repartition(3)
    found = {r["node"]: r["root"] for r in components.components(simhash.near_links(df, scheme, tile)).collect()}
    label = plain_components(values)
    for i in range(len(values)):
        for j in range(i):
            assert (label[i] == label[j]) == (found.get(nodes[i], nodes[i]) == found.get(nodes[j], nodes[j]))


def test_golay_code_is_perfect():
    _, patterns, lightest = simhash.coset_table(*simhash.GOLAY[:2], 3)
    assert all(len(p) == 1 for p in patterns) and int(np.bitwise_count(lightest).max()) == 3
    _, patterns, _ = simhash.coset_table(*simhash.RESIDUE[:2], 3)
    assert all(len(p) for p in patterns)


@pytest.mark.parametrize("n", [2, 40])
def test_components_of_paths_and_hubs(spark, n):
    path = [(i, i + 1) for i in range(0, n)]
    hub = [(1000, 1000 + i) for i in range(1, n)]
    edges = spark.createDataFrame([*path, *hub, (1, 1)], "a long, b long").repartition(4)
    got = {r["node"]: r["root"] for r in components.components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 1000 for i in range(n)}}


def test_near_copies(odd, rows):
    out = near_copies.drop_near_copies(odd)
    assert out.schema == odd.schema
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(0) == 1 and 7 not in ids and 8 not in ids  # near copies of document 5
    assert {9, 10, 11, 12, 13, 15} <= set(ids) and len(ids) == len(set(ids)) or ids.count(5) <= 2


def plain_shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("n", [9, 60, 400])
def test_similar_pairs_by_brute_force(spark, n):
    """Pairs at 0.70 to 0.90 end in one group exactly if their shingle sets reach 0.8."""
    rng, rows, want = np.random.default_rng(n), [], []
    for k in range(160):
        own = [f"p{k}w{i}" for i in range(n + 4)]
        lost = int(round(n * (0.3 * rng.random() + 0.09)))
        other = own[:len(own) - lost] + [f"q{k}w{i}" for i in range(lost if k % 2 else 0)]
        a, b = plain_shingles(" ".join(own)), plain_shingles(" ".join(other))
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
        want.append(len(a & b) >= 0.8 * len(a | b) - 1e-9)
    rows += [(1000 + k, "ab " * 400 + f"tail {' '.join(f't{k}x{i}' for i in range(60))}") for k in range(2)]  # equal but for what counts once
    got = {r["doc_id"]: r["component_id"] for r in near_copies.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert [got[2 * k] == got[2 * k + 1] for k in range(160)] == want and {True, False} == set(want)
    assert got[1000] != got[1001]


@pytest.mark.parametrize("tile", [256, 5])
def test_similar_group_dealt_in_tiles(spark, tile):
    rng = np.random.default_rng(8)
    base, rows = [f"w{i}" for i in range(60)], []
    for k in range(60):
        w = list(base)
        for at in rng.choice(60, rng.integers(1, 5), replace=False):
            w[at] = f"x{rng.integers(0, 3)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = near_copies.written(simhash.fingerprints(docs, simhash.SIMILAR).selectExpr("*", "100L AS weight"))
    node = {r["doc_id"]: r["node"] for r in prints.collect()}
    one = prints.select("node", (prints["node"] * 0).alias("root")).distinct()  # one group of all, so only the tiles decide
    found = {r["node"]: r["root"] for r in near_copies.similar(docs, prints, one, tile_rows=tile).collect()}
    sets = [plain_shingles(t) for _, t in rows]
    bits = [simhash.fingerprint(t.encode(), simhash.SIMILAR)[:2] for _, t in rows]
    label = list(range(60))
    for i in range(60):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and np.bitwise_count(bits[i] ^ bits[j]).sum() <= 35:
                label = [label[j] if x == label[i] else x for x in label]
    for i in range(60):
        for j in range(i):
            assert (label[i] == label[j]) == (found.get(node[i], node[i]) == found.get(node[j], node[j]))


@pytest.mark.parametrize("tile", [2048, 30])
def test_candidates_are_all_near_pairs_that_meet(spark, tile):
    """The two rounds leave the groups that comparing every home with all rows of its anchor gives."""
    rng, scheme = np.random.default_rng(11), simhash.SIMILAR
    values = rng.integers(0, 1 << 63, (6, scheme.words), dtype=np.int64).view(np.uint64)
    rows = []
    for k in range(180):  # few sources, many changes: anchors hold rows near and far
        own = values[k % 6].copy()
        for at in rng.choice(64 * scheme.words, rng.integers(0, 260), replace=False):
            own[at // 64] ^= np.uint64(1) << np.uint64(at % 64)
        rows.append(own)
    prints = np.array(rows)
    label, meet = list(range(len(rows))), {}
    for choice, row, anchor, home in simhash.anchors(prints, scheme):
        for r, a, h in zip(row.tolist(), anchor.tolist(), home.tolist()):
            meet.setdefault((choice, a), []).append((r, h))
    for some in meet.values():
        for i, h in some:
            for j, _ in some:
                if h and np.bitwise_count(prints[i, :2] ^ prints[j, :2]).sum() <= scheme.threshold and label[i] != label[j]:
                    label = [label[j] if x == label[i] else x for x in label]
    df = spark.createDataFrame([(k, p.tobytes()) for k, p in enumerate(rows)], "node long, fp binary").repartition(3)
    found = {r["node"]: r["root"] for r in near_copies.candidates(df, tile_rows=tile).collect()}
    for i in range(len(rows)):
        for j in range(i):
            assert (label[i] == label[j]) == (found.get(i, i) == found.get(j, j))
    assert 1 < len(set(label)) < len(rows)


def near_group(g, seed=1):
    """g texts of 300 words with a few words changed each, and as many that share nothing."""
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(300)]
    for k in range(g):
        own = list(base)
        for at in rng.choice(300, 3, replace=False):
            own[at] = f"x{rng.integers(0, 1000)}"
        yield k, " ".join(own)
        yield g + k, " ".join(f"n{k}y{i}" for i in range(40))


def test_links_in_proportion_to_a_group(spark, monkeypatch):
    links, count = [], near_copies._tiles

    def counted(*args):
        found = near_copies.written(count(*args), "counted")
        links.append(found.count())
        return found
    monkeypatch.setattr(near_copies, "_tiles", counted)
    for g in (200, 800):
        links.clear()
        docs = spark.createDataFrame(list(near_group(g)), "doc_id long, text string").repartition(4)
        kept = near_copies.drop_near_copies(docs).collect()
        assert {r["doc_id"] for r in kept} == {0, *range(g, 2 * g)}
        assert sum(links) <= 6 * g, links


@pytest.mark.parametrize("drop", [near_copies.drop_near_copies, exact_dedup.drop_exact_copies])
def test_columns_of_any_name_pass(spark, drop):
    names = ["__node", "__root", "__at", "__id", "__ID_", "rows", "doc_id_", "fp", "__n_bytes", "__sha256", "__keep_id", "__ties", "__own_ties", "__own_keep_id", "keep_id"]
    rows = [(i, t, *[f"{c}{i}" for c in names]) for i, t in [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "a b c d e f g"), (None, "x"), (3, None), (4, "")]]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in names))
    got = drop(df)
    assert got.schema == df.schema and sorted((r["text"] or "") for r in got.collect()) == ["", "a b c d e f g", "x"]
    assert all(tuple(r) in set(rows) for r in got.collect())


def plain_repeats(rows, length=50):
    first = {}
    order = [(i if i is not None else 1 << 63, (t or "").encode()) for i, t in rows]
    for i, b in order:
        for p in range(len(b) - length + 1):
            s = b[p:p + length]
            first[s] = min(first.get(s, i), i)
    out = Counter()
    for (ident, _), (i, b) in zip(rows, order):
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - length + 1):
            if first[b[p:p + length]] < i:
                gone[p] += 1
                gone[p + length] -= 1 if p + length < len(gone) else 0
        lost = np.cumsum(gone)[:len(b)] > 0
        kept = bytes(x for x, m in zip(b, lost) if not m)
        spans = int(np.sum(lost & ~np.concatenate([[False], lost[:-1]]))) if len(b) else 0
        out[ident, len(b), int(lost.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_suffix_dedup_of_odd_rows(odd, rows):
    got = suffix_dedup.remove_repeats(odd).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == plain_repeats(rows)


def test_suffix_dedup_of_shared_passages(spark):
    rng = np.random.default_rng(3)
    word = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, rng.integers(2, 8))) for _ in range(200)]
    say = lambda n: " ".join(word[i] for i in rng.integers(0, 200, n))
    shared = [say(int(n)) for n in rng.integers(5, 40, 12)]
    rows = []
    for i in range(120):
        parts = [say(int(rng.integers(0, 30)))]
        for _ in range(rng.integers(0, 3)):
            s = shared[rng.integers(0, 12)]
            a = int(rng.integers(0, 20))
            parts += [s[a:], say(int(rng.integers(0, 10)))]
        rows.append((int(rng.integers(0, 110)), " ".join(parts)))
    rows += [(200, "z" * 400), (201, "y" + "z" * 120), (202, "zé" * 80), (203, "zé" * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.remove_repeats(df).drop("kept").collect()
    assert Counter(tuple(r) for r in got) == plain_repeats(rows)


def test_loser_tree_merges_with_prefixes():
    rng = np.random.default_rng(2)
    runs = [sorted(bytes(rng.integers(97, 99, rng.integers(0, 12)).astype(np.uint8)) for _ in range(rng.integers(0, 30))) for _ in range(7)]
    coded = []
    for run in runs:
        before, out = b"", []
        for s in run:
            out.append((suffix_dedup._common(before, s, 0), s))
            before = s
        coded.append(out)
    merged, before = [], b""
    for r, i, m in suffix_dedup.merge_runs(coded):
        s = coded[r][i][1]
        assert m == suffix_dedup._common(before, s, 0)
        merged.append(s)
        before = s
    assert merged == sorted(s for run in runs for s in run)


def plain_phrases(text):
    w, places, labels = words(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i:i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_licenses(odd, rows):
    got = licenses.scan(odd).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((i, *plain_phrases(t)) for i, t in rows)
    assert {r["doc_id"]: (r["labels"], r["score"]) for r in got}[11] == ("cc-by-nc,mit", 1.0)


def test_phrases_that_touch_and_templates():
    p = licenses.phrase_places(b"cc by nc cc by nc by nc cc by nc".split(), [b"cc by nc"])
    assert p == {b"cc by nc": [0, 3, 8]}
    templates = {"t": ["a b c d e f g h i j"], "u": ["a q r"]}
    rng = np.random.default_rng(5)
    index = licenses.TemplateIndex(templates, {b"a": 5, b"j": 1}, 0.8)
    for _ in range(300):
        block = [bytes([c]) for c in rng.choice(list(b"abcdefghijqrxyz"), rng.integers(0, 14))]
        want = {}
        for label, (text,) in templates.items():
            t = {x.encode() for x in text.split()}
            if len(t & set(block)) >= 0.8 * len(t):
                want[label] = len(t & set(block)) / len(t)
        assert index.find(block) == want


def test_wrapped_notices_and_scattered_words(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated files"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    far = " ".join(w + " filler" * 30 for w in "licensed under the Apache License Version 2.0".split())
    rows = [(1, mit), (2, bsd), (3, far), (4, "x " * 500 + mit + " y" * 500), (5, mit.replace("\n", " ")), (6, None)]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "bsd", 3: "", 4: "mit", 5: "mit", 6: ""}


def test_windows_by_brute_force():
    templates = {"t": ["a b c d e f g h i j"], "u": ["a q r"]}
    rng = np.random.default_rng(6)
    index = licenses.TemplateIndex(templates, {b"a": 5, b"j": 1}, 0.8)
    for _ in range(200):
        own = [bytes([c]) for c in rng.choice(list(b"abcdefghijqrxyz"), rng.integers(0, 60))]
        want = {}
        for label, (text,) in templates.items():
            t = [x.encode() for x in text.split()]
            best = max((len(set(t) & set(own[i:i + 2 * len(t)])) for i in range(len(own))), default=0)
            if best >= 0.8 * len(t):
                want[label] = best / len(t)
        assert index.find_near(own) == want


def test_empty_tables(none, items):
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.decontaminate(none, items.limit(0)).count() == 0
    assert simhash.simhash_components(none).count() == 0 and near_copies.drop_near_copies(none).count() == 0
    assert suffix_dedup.remove_repeats(none).count() == 0
    assert licenses.scan(none).count() == 0


def test_empty_benchmark(odd, items):
    assert not any(r["contaminated"] for r in decontaminate.contamination(odd, items.limit(0)).collect())
