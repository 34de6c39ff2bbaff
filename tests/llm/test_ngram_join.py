import random

import numpy as np
import pyarrow as pa
import pytest

import netsift.llm.ngram_join as nj
from netsift.llm.shingles import shingle_sets, text_buffers
from tests.llm.fixtures import docs


def shingles(text, n):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def brute(rows, n, num, den):
    sets = [shingles(t, n) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, len(sets[i]), low.get(root(i))) for i, (d, _, _) in enumerate(rows)), key=repr)


def near(seed, groups=6, copies=12, words=60):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(3)) for _ in range(150)]
    passage = [rng.choice(vocabulary) for _ in range(25)]
    rows, at = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words + rng.randint(0, 40))] + (passage if rng.random() < 0.6 else [])
        for _ in range(rng.randint(1, copies)):
            text = base[:]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                k = rng.randrange(len(text))
                if rng.random() < 0.5:
                    text[k] = rng.choice(vocabulary)
                else:
                    del text[k]
            rows.append((at * 7 % 1009, " ".join(text), "s"))
            at += 1
    rng.shuffle(rows)
    return rows


HOSTILE = [(1, None, "s"), (2, "", "s"), (3, " \n\t", "s"), (4, "One", "s"), (5, "one", "s"), (6, "one two", "s"), (7, "ONE  two", "s"), (None, "a b c d", "s"), (8, "a b c d", "s"), (9, "a b c d", "s"), (9, "a b c d", "s"), (9, "x y z w", "s"), (10, "É a b", "s"), (11, "é a b", "s"), (12, "w " * 5000, "s"), (13, "w " * 3, "s"), (None, "lonely words here", "s")]


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, n, num, den):
    monkeypatch.setattr(nj, "LIST", 4)  # long lists and several blocks in small groups as well
    monkeypatch.setattr(nj, "BLOCK_SETS", 3)
    rows = near(seed)
    got = sorted(map(tuple, nj.jaccard_join(docs(spark, rows), n, num, den).collect()), key=repr)
    assert got == brute(rows, n, num, den)


@pytest.mark.parametrize("seed", [3, 4])
def test_large_groups_meet_block_by_block(spark, monkeypatch, seed):
    """Groups of many blocks, with few pivots and without any broadcast."""
    monkeypatch.setattr(nj, "LIST", 2)
    monkeypatch.setattr(nj, "BLOCK_SETS", 4)
    monkeypatch.setattr(nj, "PIVOTS", 1)
    monkeypatch.setattr(nj, "BROADCAST_BYTES", 0)
    rows = near(seed, groups=3, copies=60)
    for n, num, den in ((5, 80, 100), (1, 60, 100)):
        got = sorted(map(tuple, nj.jaccard_join(docs(spark, rows), n, num, den).collect()), key=repr)
        assert got == brute(rows, n, num, den)


def test_counters_do_not_saturate(spark):
    rows = [(i, "common words here " + " ".join(f"w{i}x{k}" for k in range(6)), "s") for i in range(700)]
    counts = nj.gram_counts(docs(spark, rows), 3)
    assert len(counts) == nj.LEAST_SLOTS and counts.max() == int(8 * np.log2(701))


def test_hostile(spark):
    got = sorted(map(tuple, nj.jaccard_join(docs(spark, HOSTILE)).collect()), key=repr)
    assert got == brute(HOSTILE, 3, 90, 100)
    assert nj.jaccard_join(docs(spark, [])).collect() == []


def one_row_each(rows, n=5, num=80, den=100):
    """Brute force over rows: components by texts, the row of smallest id (null last) of each; wordless ones all stay."""
    sets = [shingles(t, n) for _, t, _ in rows]
    left, kept = list(range(len(rows))), []
    while left:
        group, reach = [], [left.pop(0)]
        while reach:
            i = reach.pop()
            group.append(i)
            near_ = [j for j in left if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]
            reach += near_
            left = [j for j in left if j not in near_]
        least = min((rows[i][0] is None, rows[i][0] or 0) for i in group)
        kept.append({rows[i][:2] for i in group if (rows[i][0] is None, rows[i][0] or 0) == least})
    return kept


def check_one_of_each(spark, rows):
    df = docs(spark, rows)
    out = nj.one_of_each(df)
    assert out.columns == df.columns
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    want = one_row_each(rows)
    assert len(got) == len(want)
    for row in got:  # each component once
        at = next(k for k, group in enumerate(want) if row in group)
        want.pop(at)


@pytest.mark.parametrize("bound", [0, 1 << 20])
def test_one_of_each(spark, monkeypatch, bound):
    monkeypatch.setattr(nj, "BROADCAST_BYTES", bound)
    check_one_of_each(spark, near(3))
    check_one_of_each(spark, HOSTILE)
    check_one_of_each(spark, [(1, "a b", "s"), (1, "a b", "s"), (2, None, "s"), (2, None, "s"), (3, None, "s")])


A, B, C = "all of this is one text", "quite another text stands in here", "third words that none of them share"


@pytest.mark.parametrize("rows", [
    [(5, A, "s"), (5, B, "s"), (7, C, "s")],
    [(5, A, "s"), (5, B, "s"), (3, B, "s")],
    [(5, A, "s"), (5, B, "s"), (5, A, "s"), (9, A, "s")],
    [(None, A, "s"), (None, B, "s"), (4, C, "s"), (4, C, "s")],
    [(None, A, "s"), (None, A, "s"), (None, None, "s"), (None, None, "s"), (None, "", "s")],
    [],
])
def test_distinct_texts_stay_whatever_their_ids(spark, rows):
    check_one_of_each(spark, rows)


def test_clashing_columns_stay(spark):
    df = docs(spark, [(1, A, "s"), (2, A, "s")]).selectExpr("doc_id", "text", "1 as mark", "2 as __mark", "3 as __stays", "4 as component", "5 as __ID")
    assert [tuple(r) for r in nj.one_of_each(df).collect()] == [(1, A, 1, 2, 3, 4, 5)]


def test_trie_links_are_all_links():
    rng = np.random.default_rng(5)
    for _ in range(30):
        base = rng.choice(400, 60, replace=False)
        sets = []
        for _ in range(25):
            s = set(base.tolist())
            for _ in range(rng.integers(0, 8)):
                s.discard(int(rng.choice(base)))
                s.add(int(rng.integers(0, 400)))
            sets.append(np.array(sorted(s), np.int64))
        trie = nj._Trie(sets, list(range(25)))
        for k, own in enumerate(sets):
            got = sorted(trie.links(own, 400, 80, 100, lambda i: False))
            assert got == [i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, own)) >= 80 * len(np.union1d(s, own))]


def test_shingles_of_batches():
    texts = ["a b c a b c", None, "", "x", "x y", " lead  trail ", "A b C", "a b c", "é b c d", "a\x0bb\x0cc d\r\ne"]
    data, offsets = text_buffers(pa.array(texts).slice(0))
    hashes, bounds = shingle_sets(data, offsets, 3)
    assert np.diff(bounds).tolist() == [len(shingles(t, 3)) for t in texts]
    own = [set(hashes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    assert own[6] == own[7] and own[7] <= own[0] and not own[3] & own[4]
    data, offsets = text_buffers(pa.array(["zz", *texts]).slice(1))
    assert np.array_equal(shingle_sets(data, offsets, 3)[0], hashes)


def test_parts_hash_alike(monkeypatch):
    """Words and sets do not depend on how texts are cut into parts."""
    import netsift.llm.shingles as sh

    rng = random.Random(8)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["", "x" * 500, " " * 300, "é " * 99]
    data, offsets = text_buffers(pa.array(texts))
    whole = sh.word_hashes(data, offsets), shingle_sets(data, offsets, 3)
    for part in (1, 7, 64):
        monkeypatch.setattr(sh, "PART", part)
        for a, b in zip(whole, (sh.word_hashes(data, offsets), shingle_sets(data, offsets, 3))):
            assert all(np.array_equal(x, y) for x, y in zip(a, b))
    monkeypatch.setattr(nj, "BATCH_TEXT", 40)
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    got = [s for part, hashes, bounds in nj._sets(iter([batch.slice(3), batch.slice(0, 3)]), 0, 3) for s in (hashes[lo:hi].tolist() for lo, hi in zip(bounds[:-1], bounds[1:]))]
    hashes, bounds = whole[1]
    want = [hashes[lo:hi].tolist() for lo, hi in zip(bounds[:-1], bounds[1:])]
    assert got == want[3:] + want[:3]
