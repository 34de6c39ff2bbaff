import re

import pytest

from netsift.llm.mixing import HASH_BITS, mix, mixed
from tests.llm.fixtures import docs

import hashlib


def brute(rows):
    """The mix by sorting; rows: (doc_id, text, source)."""
    sized = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s, int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[: HASH_BITS // 4], 16)) for i, t, s in rows]
    order = sorted({s for _, _, s, _ in sized}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    size = {s: sum(n for _, n, x, _ in sized if x == s) for s in order}
    total, full = sum(size.values()), set()
    while True:
        rest = [s for s in order if s not in full]
        level = (total - sum(3 * size[s] for s in full)) / max(1, sum(weight[s] for s in rest))
        more = {s for s in rest if level * weight[s] > 3 * size[s]}
        if not more:
            break
        full |= more
    target = {s: 3.0 * size[s] if s in full else level * weight[s] for s in order}
    out = []
    for i, n, s, h in sized:
        whole = int(target[s] // size[s]) if size[s] else 0
        left = target[s] - whole * size[s]
        incl = sum(m for _, m, x, g in sized if x == s and g <= h)
        own = sum(m for _, m, x, g in sized if x == s and g == h)
        extra = left > 0 and (incl <= left or incl - left < left - (incl - own))
        out.append((i, n, size[s], round(target[s], 6), (whole + extra) * n))
    return sorted(out, key=repr)


CASES = {
    "several": [(k, "w " * (k % 7 + 1), f"s{k % 5}") for k in range(60)],
    "hot": [(k, "a b c", "s0" if k % 3 else None) for k in range(40)],
    "nulls": [(None, "a b", None), (1, None, "x"), (2, "", "x"), (3, " \t\n\x0b", "é"), (4, "a b c", "z")],
    "repeated": [(5, "a b c", "x"), (5, "a b c", "x"), (5, "other", "y"), (6, "d", "y")],
    "one": [(1, "a", "x")],
}


@pytest.mark.parametrize("name", CASES)
def test_mix_is_the_sorted_mix(spark, name):
    got = [(r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in mix(docs(spark, CASES[name])).collect()]
    assert sorted(got, key=repr) == brute(CASES[name])


def test_mixed_repeats_rows(spark):
    rows = CASES["several"]
    df = docs(spark, rows)
    copies = {r["doc_id"]: r["copies"] for r in mix(df).collect()}
    out = mixed(df)
    assert out.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in copies.items() if v}
    assert max(copies.values()) <= 3


def test_empty(spark):
    assert mix(docs(spark, [])).collect() == []
    assert mixed(docs(spark, [])).collect() == []
