"""Token files, exact dedup, packing and shards."""
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from watchpost.llm import common, exact_dedup, packing, shuffle_shards, token_files, tokens


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cached_pieces_give_the_ids_of_whole_texts(tokenizer, rows):
    code = tokens.Encoder(tokens.default_path(), room=50)  # generations turn often
    texts = [t for _, t in rows] * 2 + ["  two  blanks\n\n and 12.5% off's we're \x85\xa0x", "# <| a |>"]
    for text, got in zip(texts, code.encode(texts)):
        assert got.tolist() == ids_of(tokenizer, text)[:-1]


def test_token_files_round_trip(spark, odd, rows, tokenizer, tmp_path):
    folder = f"file://{tmp_path}/t"
    manifest = token_files.write_token_files(odd, folder, seq_len=16, batch_seqs=4)
    got = token_files.read_token_files(manifest, folder).collect()
    want = sorted(((i, t) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start, expect = 0, []
    for i, t in want:
        ids = ids_of(tokenizer, t)
        expect.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expect


def test_sequences_are_equal_length_and_masked(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/t"
    fs, root = token_files.store(folder)
    for part in token_files.write_token_files(odd, folder, seq_len=16, batch_seqs=4).collect():
        f = token_files.TokenFile(fs, root, part["part"])
        n = -(-part["n_tokens"] // 16)
        flat = f.ids(0, part["n_tokens"]).tolist()
        assert sum(int(f.mask(i).sum()) for i in range(n)) == part["n_tokens"]
        for i in range(n):
            s = f.sequence(i)
            assert len(s) == 16 and s[f.mask(i)].tolist() == flat[16 * i:16 * i + 16]


def test_exact_groups(odd, rows):
    got = exact_dedup.exact_groups(odd, keep="largest", budget_bytes=2000).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    import hashlib
    by = {hashlib.sha256(t.encode()).hexdigest(): v for t, v in groups.items()}
    assert Counter(r["text_sha256"] for r in got) == Counter({k: len(v) for k, v in by.items()})
    kept = Counter()
    for r in got:
        ids = by[r["text_sha256"]]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (best, len(ids))
        assert not r["kept"] or r["doc_id"] == best
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) == {1}


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_dropping_exact_copies_keeps_columns(odd, rows, keep):
    out = exact_dedup.drop_exact_copies(odd, keep=keep)
    assert out.schema == odd.schema
    assert sorted((r["text"] or "") for r in out.collect()) == sorted({t or "" for _, t in rows})


def test_trie_merges_and_spills_by_subtree():
    trie = exact_dedup.PatriciaTrie(lambda a, b: a + b)
    keys = [b"", b"a", b"ab", b"abc", b"abd", b"b" * 300, b"b" * 299 + b"c", b"abc", b"xyz"]
    for k in keys:
        trie.insert(k, 1)
    spilled = dict(trie.spill_largest())
    rest = dict(trie.items())
    assert not set(spilled) & set(rest) and {**spilled, **rest} == Counter(keys)
    for k in sorted(keys):
        trie.insert(k, 1)
    off = list(trie.spill_off_path(b"abd"))
    assert b"abd" not in dict(off) and Counter(dict(off + list(trie.items()))) == Counter(keys)


def test_packing(odd, rows, tokenizer):
    got = packing.pack(odd, room=64).collect()
    want = Counter()
    for i, t in rows:
        ids = ids_of(tokenizer, t)
        first = (len(ids) - 1) % 64 + 1
        for k, a in enumerate([0, *range(first, len(ids), 64)]):
            b = first if k == 0 else a + 64
            want[i, k, a, b - a, crc(ids[a:b])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(bins) <= total / 64 * 1.1 + 2


def test_plan_holds_the_histogram_and_is_near_the_bound():
    rng = np.random.default_rng(1)
    histogram = Counter(rng.integers(1, 1025, 5000).tolist())
    plan = packing.make_plan(histogram, 1024)
    held = Counter()
    for config, n in plan:
        assert sum(length * count for length, count in config) <= 1024
        for length, count in config:
            held[length] += n * count
    assert held == histogram
    assert sum(n for _, n in plan) <= sum(k * v for k, v in histogram.items()) / 1024 * 1.03
    assert packing.make_plan({}, 1024) == []


def test_knapsack_matches_brute_force():
    lengths, value = np.array([2, 3, 7]), np.array([1.0, 1.7, 4.1])
    best = max(2 * 0 + a * 1.0 + b * 1.7 + c * 4.1 for a in range(7) for b in range(5) for c in range(2) if 2 * a + 3 * b + 7 * c <= 13)
    config = packing.price(lengths, value, 13, np.array([9, 9, 9]))
    assert abs(sum(value[list(lengths).index(k)] * v for k, v in config.items()) - best) < 1e-9


def test_shards(odd, rows):
    got = shuffle_shards.shard_rows(odd, n_shards=5).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "rows" and r["grown_shard"] is None
    counts = [len(slots[s]) for s in range(5)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = shuffle_shards.shard_rows(odd.repartition(7), n_shards=5).collect()
    assert {tuple(r) for r in again} == {tuple(r) for r in got}


def test_empty_tables(none, tmp_path):
    assert token_files.token_output(none).count() == 0
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_exact_copies(none).count() == 0
    assert packing.pack(none).count() == 0
    assert shuffle_shards.shard_rows(none).count() == 0


def test_portions_cover_a_batch():
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "", "b" * 100, "c"]})
    parts = list(common.portions(batch, limit=12))
    assert [p.column("text").to_pylist() for p in parts] == [["a" * 10, None, ""], ["b" * 100], ["c"]]
