"""Filter audit, whitening and bottom-k sketches against plain versions."""
import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from watchpost.llm import filter_audit, sketches, whitening

ONE = "id, key, none, mark, part, n, good, toxic, state, added, words, text2"


def plain_fails(rows):
    low = {}
    for ident, text, _ in rows:
        if ident is not None:
            low[text or ""] = min(ident, low.get(text or "", ident))
    for ident, text, part in rows:
        text = text or ""
        words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
        fails = {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if ident is not None and ident > low[text] else set()
        yield ident, part or "", fails


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    parts = defaultdict(list)
    for ident, part, fails in plain_fails(rows):
        parts[part].append((ident, fails))
    out, shapley = {}, Counter()
    for part, each in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            here = each
            for step, f in enumerate(order, 1):
                gone = [x for x in here if f in x[1]]
                stay = [x for x in here if f not in x[1]]
                out[part, order, step] = (len(stay), len(gone), sum(f in x[1] for x in each) - len(gone), sum(x[1] == {f} for x in each),
                                          sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone))
                shapley[part, f] += len(gone)
                here = stay
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(docs, labels):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:10] for r in filter_audit.audit(docs, labels).collect()}


@pytest.fixture(scope="module")
def audit_rows():
    long = " ".join(f"w{i}" for i in range(250))
    poor = " ".join(f"w{i % 9}" for i in range(250))
    texts = [long, poor, long.upper(), long + " #", poor.upper() + "$", "short", "Short & LOUD", "", None, "Ünï ÇA x y\x1cz"]
    rows = [(i, t, "ab"[i % 2]) for i, t in enumerate(texts * 3)]
    return rows + [(0, long, "a"), (0, long, "a"), (3, long, None), (None, long, "a"), (None, None, None), (50, long, "c"), (50, poor, "c"), (7, "Short & LOUD", "b")]


def test_audit(spark, audit_rows):
    names = [c for c in ONE.split(", ")]
    docs = spark.createDataFrame([(*r, *["x"] * len(names)) for r in audit_rows], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in names)).repartition(3)
    labels = [(0, 1, 0), (1, 1, 1), (3, 0, 1), (3, 1, None), (6, None, 1), (50, 1, 0), (None, 1, 1), (999, 1, 1), (16, 1, 0), (10, 1, 1)]
    marks = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, part string")
    assert audited(docs, marks) == plain_audit(audit_rows, labels)


def test_audit_of_odd_and_empty_tables(spark, odd, rows, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(odd, labels) == plain_audit([(i, t, "s") for i, t in rows], [])
    assert filter_audit.audit(none, labels).count() == 0


def plain_components(vectors):
    x = np.array(sorted({tuple(math.floor(64 * c) + 1_000_000 for c in v) for v in vectors}), np.int64)
    n, s = len(x), x.sum(0)
    v = ((n * x - s) / n).T @ ((n * x - s) / n) / n
    e, q = np.linalg.eigh(v)
    return n, s, e[::-1], q[:, ::-1].T


def checked(got, vectors, k):
    """Compare with a dense decomposition, up to the sign of each component."""
    n, s, e, q = plain_components([v for _, v in vectors])
    assert len(got) == len(vectors) * k
    want = defaultdict(list)
    for ident, v in vectors:
        x = [math.floor(64 * c) + 1_000_000 for c in v]
        apart = [n * a - int(b) for a, b in zip(x, s)]
        want[ident].append((sum(a * a for a in apart), np.array(apart) / n @ q[:k].T / np.sqrt(e[:k])))
    rows = defaultdict(list)
    for r in got:
        rows[r["component"]].append(r)
        assert r["n"] == n and r["deviation"] in {d for d, _ in want[r["vec_id"]]} and r["identity_error"] < 1e-9
        assert abs(r["explained"] - e[r["component"] - 1] / e.sum()) < 1e-12
    for c, some in rows.items():
        a = np.array(sorted((r["vec_id"], abs(r["whitened"])) for r in some))
        b = np.array(sorted((i, abs(w[c - 1])) for i, ws in want.items() for _, w in ws))
        assert np.allclose(a, b, atol=1e-7)


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, x string, rows string").repartition(4)


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 20)) * np.linspace(1, 4, 20) @ rng.standard_normal((20, 20)) / 8
    vectors = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    vectors += [(1000 + i, vectors[0][1]) for i in range(200)] + [(7, vectors[3][1])]
    bad = [(5000, None), (5001, [None] + [0.0] * 19), (5002, [float("nan")] * 20), (5003, [float("inf")] + [0.0] * 19), (5004, []), (5005, [1.0, 2.0]), (5006, [1e30] + [0.0] * 19)]
    checked(whitening.whiten(vector_table(spark, vectors + bad)).collect(), vectors, 16)


def test_whitening_of_low_rank_and_empty_tables(spark):
    rng = np.random.default_rng(4)
    flat = [(i, [float(a), float(a), float(b), 0.5]) for i, (a, b) in enumerate(rng.integers(-3, 4, (60, 2)))]
    checked(whitening.whiten(vector_table(spark, flat)).collect(), flat, 2)
    assert whitening.whiten(vector_table(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    assert whitening.whiten(vector_table(spark, [(1, None)]).limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("spectrum", [[4, 4, 4, 1, 1, 1], [9, 9, 1, 0, 0, 0], [1e4, 10, 1, 1e-2, 1e-2, 1e-3], [0, 0, 0, 0, 0, 2]])
def test_bidiagonal_form_with_equal_and_zero_values(spectrum):
    """Equal eigenvalues close the Krylov space early; the fresh starts must find every copy."""
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((6, 6)))[0]
    gram = q @ np.diag(np.array(spectrum, float)) @ q.T
    b, v = whitening.bidiagonalise(lambda x: gram @ x, 6, float(np.sqrt(np.trace(gram))))
    assert np.allclose(v @ v.T, np.eye(6), atol=1e-12) and np.allclose(np.tril(b, -1), 0) and np.allclose(np.triu(b, 2), 0)
    assert np.allclose(np.sort(np.linalg.svd(b)[1] ** 2), np.sort(spectrum), atol=1e-9 * max(spectrum))
    assert np.allclose(v.T @ b.T @ b @ v, gram, atol=1e-9 * max(spectrum))


def test_deviations_past_doubles():
    x, sums = np.array([[3_000_000_000], [1]], np.int64), np.array([0], np.int64)
    assert whitening.deviations(x, 1, sums).tolist() == [9_000_000_000_000_000_000, 1]
    with pytest.raises(OverflowError):
        whitening.deviations(x, 2, sums)


def plain_shingles(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_sketch_of_edited_texts(odd, rows):
    got = sketches.edited_likeness(odd).collect()
    assert len(got) == len(rows)
    prints = {r["doc_id"]: r for r in got}
    once = [(i, t) for i, t in rows if i is not None and i != 5]
    order = sorted({i for i, _ in rows if i is not None}, reverse=True)
    text = dict(once)
    for ident in text:
        after = order[order.index(ident) + 1:][:1]
        if not after or after[0] not in text:
            continue  # followed by rows of equal or null id
        own, other = text[ident] or "", text[after[0]] or ""
        third = len(own) // 3
        edited = own[:len(own) - third] + other[:third]
        r = prints[ident]
        assert (r["n_chars"], r["edited_sha256"]) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = map(plain_shingles, (own, edited, other))
        near = (lambda x, y: 1e-9 if len(x | y) <= sketches.K else 0.15)
        assert abs(r["near_edited"] - likeness(a, b)) <= near(a, b) and abs(r["near_next"] - likeness(a, c)) <= near(a, c)
        assert abs(r["n_shingles"] - len(a)) <= (0.3 * len(a) if len(a) >= sketches.K else 0)
        assert abs(r["contained"] - (len(a & b) / len(a) if a else 1)) <= (0.35 if len(a | b) > sketches.K else 1e-9)
    same = defaultdict(set)
    for r in got:
        same[r["edited_sha256"]].add(r["edited_fingerprint"])
    assert all(len(x) == 1 for x in same.values())


def test_next_of_last_single_repeated_and_null(spark, none):
    look = lambda rows: Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in sketches.edited_likeness(
        spark.createDataFrame(rows, "doc_id long, text string")).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert look([(1, "abcdef")]) == {(1, 6, sha("abcdab")): 1}
    assert look([(1, "abcdef"), (9, "é😀x"), (4, "")]) == {(1, 6, sha("abcdé😀")): 1, (9, 3, sha("é😀")): 1, (4, 0, sha("")): 1}
    assert look([(1, "abcdef")] * 3 + [(2, "uvwxyz")]) == {(1, 6, sha("abcduv")): 3, (2, 6, sha("uvwxab")): 1}
    assert look([(None, "abcdef"), (2, "uvwxyz"), (None, None)])[(2, 6, sha("uvwxab"))] + look([(None, "abc"), (2, "uvw")])[(None, 3, sha("abu"))] >= 1
    assert sketches.edited_likeness(none).count() == 0


def test_merging_parts_gives_the_sketch_of_the_whole(spark):
    words = [f"w{i * 37 % 1009}" for i in range(3000)]
    whole = spark.createDataFrame([(0, " ".join(words))], "g long, t string")
    parts = spark.createDataFrame([(0, " ".join(words[i:i + 304])) for i in range(0, 3000, 300)] + [(None, "a b c d e f"), (1, ""), (1, None)], "g long, t string").repartition(5)
    one = sketches.with_sketch(whole, "t", "s").collect()[0]["s"]
    got = {r["g"]: r["s"] for r in sketches.merge_parts(sketches.with_sketch(parts, "t", "s"), "g", "s").collect()}
    assert got[0] == one and len(one) == sketches.K and one == sorted(set(one)) and len(got[None]) == 2 and got[1] == []
    pair = whole.selectExpr("array(1L, 5L) AS a", "array(2L, 5L, 9L) AS b").select(sketches.merged("a", "b", 3).alias("m"), sketches.resemblance("a", "b", 4).alias("r"))
    assert tuple(pair.collect()[0]) == ([1, 2, 5], 0.25)


def test_no_python_in_the_native_plan(odd):
    plan = sketches.edited_likeness(odd.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|ObjectHash|MapElements", plan)
