import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from foliant.llm import line_dedup, near_dup
from foliant.llm.exact_dedup import exact_dedup
from tests.llm.conftest import make


def brute_exact(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    by = defaultdict(list)
    for i, t, *_ in rows:
        by[norm(t)].append((i, len(t or "")))
    out = Counter()
    for i, t, *_ in rows:
        g = by[norm(t)]
        keep = min(g, key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        out[i, keep[0], len(g), (i, len(t or "")) == keep, hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("runs", "fan_in", "key_bits"), [(256, 16, 64), (4, 2, 3), (1, 2, 1)])
def test_exact_dedup_is_the_brute_force_one(odd, odd_rows, runs, fan_in, key_bits):
    got = exact_dedup(odd.repartition(5), runs=runs, fan_in=fan_in, key_bits=key_bits)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == brute_exact(odd_rows)


def test_a_hot_group(spark):
    rows = [(i, "same  text" if i % 3 else f"text {i // 9}", None, None, 0) for i in range(300)]
    got = exact_dedup(make(spark, rows).repartition(20), runs=8, fan_in=2)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got.collect()) == brute_exact(rows)


def test_empty_tables(none):
    assert exact_dedup(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0


def brute_lines(rows):
    """Chunks by the same boundaries, in plain Python; rows that repeat id and text are one document."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    spans = {}
    for i, t in {(i, t) for i, t, *_ in rows if t is not None}:
        ls = t.split("\n")
        h = [md5(x) for x in ls]
        roll = [h[0]] + [md5(h[k - 1] + h[k]) for k in range(1, len(h))]
        cuts = [0] + [k for k in range(1, len(h)) if roll[k] < roll[k - 1] and (k == len(h) - 1 or roll[k] <= roll[k + 1])] + [len(h)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1 and sum(bool(x.strip(" ")) for x in ls[a:b]) > 1:
                spans.setdefault("\n".join(ls[a:b]), []).append((i is None, i or 0, a, t, b))
    gone = defaultdict(set)
    for found in spans.values():
        for _, i, a, t, b in sorted(found, key=lambda x: x[:3])[1:]:
            gone[i, t] |= set(range(a, b))
    return Counter((i, None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i or 0, t]), len(gone[i or 0, t])) for i, t, *_ in rows)


def test_line_dedup_is_the_brute_force_one(spark, odd, odd_rows):
    got = line_dedup.line_dedup(odd)
    assert got.columns[: len(odd.columns) - 1] == [c for c in odd.columns if c != "kept_in"]
    assert Counter((r.doc_id, r.text, r.n_removed) for r in got.collect()) == brute_lines(odd_rows)
    r = random.Random(5)
    shared = [[f"shared {k} line {j}" for j in range(12)] for k in range(3)]
    rows = []
    for i in range(60):
        ls = [f"own {i} {j}" for j in range(r.randint(0, 8))]
        ls += r.choice(shared) if r.random() < 0.7 else []
        rows.append((i, "\n".join([*ls, *(f"tail {i} {j}" for j in range(r.randint(0, 3)))]), None, None, 0))
    got = {x.doc_id: x for x in line_dedup.line_dedup(make(spark, rows)).collect()}
    assert Counter((x.doc_id, x.text, x.n_removed) for x in got.values()) == brute_lines(rows)
    assert sum(x.n_removed > 5 for x in got.values()) > 20
    assert all(x.n_removed == 0 for i, x in got.items() if "shared" not in rows[i][1])


def brute_runs(rows):
    """Every pair of neighbouring lines that are not blank, in order of id and place; what an earlier pair says again goes."""
    first, out = {}, {}
    for i, t in sorted(rows):
        ls = t.split("\n")
        full = [k for k, x in enumerate(ls) if x.strip(" ")]
        gone = set()
        for k, (a, b) in enumerate(zip(full, full[1:], strict=False)):
            for x, y in {(a, b), (0 if not k else a, b), (a, len(ls) - 1 if k == len(full) - 2 else b)}:
                j, z = first.setdefault(tuple(ls[x : y + 1]), (i, x))
                if (j, z) != (i, x):
                    gone |= set(range(max(x, z + y - x + 1 if j == i else 0), y + 1))
        left = [x for k, x in enumerate(ls) if k not in gone]
        out[i] = "\n".join(left), len(gone), sum(k - 1 not in gone for k in gone)
    return out


def test_every_repeated_run_of_two_lines_goes(spark, odd, none):
    r = random.Random(6)
    shared = [[f"passage {k} line {j}" if j % 3 or k % 2 else "" for j in range(1, n)] for k, n in enumerate([3, 3, 4, 5, 6, 7, 9])]
    rows = [(0, "\n".join(x for p in shared for x in [*p, "end"]))]
    for i in range(1, 50):
        rows.append((i, "\n".join([*(f"own {i} {j}" for j in range(r.randint(1, 6))), *r.choice(shared), *(f"tail {i} {j}" for j in range(r.randint(1, 4)))])))
    rows += [(60, "a a\na a\na a\na a"), (61, "c\nd\nc\nd\nc"), (62, "\n\nx y\n\nz\n"), (63, "\n\nx y\n\nz\n"), (64, "x y\nz"), (65, "one line"), (66, " \n\n"), (67, "b\n\n\nb\n")]
    got = {x.doc_id: (x.text, x.n_removed, x.chunks_removed) for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), whole=True).collect()}
    assert got == brute_runs(rows)
    assert all(f"passage {k}" not in got[i][0] for i in range(1, 50) for k in range(7)) and got[60][0] == "a a\na a" and got[63][0] == ""
    assert {x.doc_id: x.n_removed for x in line_dedup.op6_query(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {i: n for i, (_, n, _) in got.items()}
    assert line_dedup.line_dedup(odd, whole=True).count() == odd.count() and line_dedup.line_dedup(none, whole=True).count() == 0


def brute_near(rows, similarity=0.8):
    sets = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()))
    first = lambda ids: min(ids, key=lambda x: (x is None, x or 0))
    copies = defaultdict(list)
    for i, s in sets:
        copies[s].append(i)
    kinds = list(copies)
    root = list(range(len(kinds)))
    links = Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(kinds)):
        for b in range(a):
            if kinds[a] and kinds[b] and len(kinds[a] & kinds[b]) >= similarity * len(kinds[a] | kinds[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    members = defaultdict(list)
    for a, s in enumerate(kinds):
        members[find(a)] += copies[s]
    at = {s: a for a, s in enumerate(kinds)}
    return Counter((i, first(members[find(at[s])]), first(copies[s]), links[at[s]]) for i, s in sets)


def near_rows(n=160, seed=6):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[r.choice(words) for _ in range(r.randint(30, 120))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
            w[r.randrange(len(w))] = r.choice(words)
        rows.append((i, " ".join(w), None, None, 0))
    return rows


def test_near_duplicates_are_the_brute_force_ones(spark, odd, odd_rows):
    got = near_dup.near_duplicates(odd)
    assert Counter(map(tuple, got.collect())) == brute_near(odd_rows)
    rows = near_rows()
    want = brute_near(rows)
    assert sum(x[3] for x in want) > 300
    # At this recall a pair is missed once in a hundred million times, so the result is the exact one.
    assert Counter(map(tuple, near_dup.near_duplicates(make(spark, rows), block_members=7, recall=0.99999).collect())) == want


def test_one_document_of_each_class_stays(spark):
    rows = near_rows(80)
    want = {c for _, c, _, _ in brute_near(rows)}
    assert {r.doc_id for r in near_dup.one_of_each(make(spark, rows)).collect()} == want


def test_banding_reaches_its_recall():
    bands, rows = near_dup.choose_bands(0.8, 0.999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and bands * rows <= 144
    sets = [np.sort(np.random.default_rng(i).choice(1 << 40, 200, replace=False)).astype(np.uint64) for i in range(300)]
    pairs = [s.copy() for s in sets]
    for i, s in enumerate(pairs):
        s[:22] = np.random.default_rng(1000 + i).choice(1 << 40, 22)  # Jaccard 178 / 222
    a, b = near_dup.band_hashes(sets, bands, rows), near_dup.band_hashes([np.sort(s) for s in pairs], bands, rows)
    assert (a == b).any(axis=1).mean() > 0.98


def test_both_ways_to_intersect_agree():
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 500, r.integers(1, 300))).astype(np.uint64) for _ in range(60)]
    left, right = np.arange(40), np.arange(20, 60)
    mask = r.random((40, 40)) < 0.9
    want = np.array([[len(np.intersect1d(sets[a], sets[b])) if mask[i, j] else -1 for j, b in enumerate(right)] for i, a in enumerate(left)])
    got = near_dup.intersections(sets, left, right, mask)
    assert (got[mask] == want[mask]).all()


def test_gram_sets_are_those_of_each_text_alone(monkeypatch):
    r = random.Random(3)
    texts = [None, "", " \n", "one", "a b c d", "a b c d e", " a  b\tc\x0bd e f ", *(" ".join(r.choice(["x", "yy", "é", "zzz\x1c", " "]) for _ in range(r.randint(0, 40))) for _ in range(300)), "w" * 300 + " a"]
    whole = near_dup.gram_sets(pa.array([None, *texts, None]).slice(1, len(texts)))
    seen = {}
    for t, s in zip(texts, whole, strict=True):
        w = (t or "").encode().split()
        grams = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        assert len(s) == len(grams) and (np.diff(s.astype(object)) > 0).all()
        assert seen.setdefault(frozenset(grams), s.tobytes()) == s.tobytes()
    assert len({*seen.values()}) == len(seen)
    monkeypatch.setattr(near_dup, "CHUNK", 16)
    for t, s, z in zip(texts, whole, near_dup.gram_sets(pa.array(texts)), strict=True):
        assert s.tolist() == z.tolist() == near_dup.gram_sets(pa.array([t], pa.string()))[0].tolist()


def test_line_dedup_of_texts_of_many_lines(spark):
    ls = [f"line {i} of many" for i in range(100_000)]
    rows = [(1, "\n".join(ls)), (2, "\n".join([*ls[:40_000], "own", *ls[50_000:]])), (3, "x" * 2_000_000), (4, "y\n" * 30_000)]
    begun = time.time()
    got = {x.doc_id: x.n_removed for x in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()}
    assert got == {1: 0, 2: 90_000, 3: 0, 4: 29_998} and time.time() - begun < 100
