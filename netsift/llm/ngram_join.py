"""Exact n-gram Jaccard join by a prefix-tree join over bounded groups.

1. Each document becomes the set of its hashed word n-grams.  Equal sets are one
   class from the start, whatever their number.
2. A global order puts rare n-grams first: by a table of counters over all
   documents, then by hash.  The table grows with the corpus up to MOST_SLOTS bytes
   (it is only an order, so collisions cost time, not links); its counts are
   logarithms, so they do not saturate.
3. Two sets that link share at least min(SHARED, overlap) n-grams among the first
   n - ceil(t * n) + SHARED of each.  Short lists of sets with such an n-gram
   give pairs that are counted; long lists give only an edge from each set to one
   of them, by size class.  Connected components of both are groups that no link
   leaves.
4. Inside a group the ordered sets are stored in a trie and each set traverses
   it: shared beginnings are compared once, subtrees whose sizes or remaining
   lengths cannot reach the needed overlap are pruned, and sets that are known
   to be connected are skipped.  A group of any size is split into blocks, tasks of
   bounded size that return a forest of their links; a few sets of the group stand
   in all its blocks and tie them together.  Only parts of a group that are still
   apart meet again, block by block: sets of one part are never compared anew.
5. Connected components of the links are the result.

No pairs inside a large group are ever emitted; no link is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import release, reside, table, texts_of, unused
from netsift.llm.shingles import _mix, shingle_sets, text_buffers
from netsift.operators.components import connected_components
from netsift.plans.lineage import cut, forget

#: Counters of the global order: one for so many bytes of text, so many at least and at most; counters of one emitted chunk.
SLOT_BYTES, LEAST_SLOTS, MOST_SLOTS, CHUNK = 128, 1 << 18, 1 << 26, 1 << 15
#: N-grams that linking sets share at their beginnings; longest list that gives pairs.
SHARED, LIST = 4, 32
#: Sets and n-grams of a block, about.
BLOCK_SETS, BLOCK_GRAMS = 256, 1 << 20
#: Sets of a group of several blocks that stand in each of them, about.
PIVOTS = 16
#: Bytes of numbers up to which a table is broadcast; beyond, plain joins.  Parts that a long list's joins are dealt into.
BROADCAST_BYTES, SALTS = 1 << 20, 16
#: Documents, and bytes of text, that are shingled at once; a longer text on its own.
BATCH, BATCH_TEXT = 256, 2 << 20


def _maybe_broadcast(small: DataFrame, rows: int) -> DataFrame:
    """small, of so many rows of numbers, as a broadcast side where its bytes are within the bound."""
    return F.broadcast(small) if rows * 8 * len(small.columns) <= BROADCAST_BYTES else small


def _sets(batches: Iterator[pa.RecordBatch], column: int, n: int):
    """(batch part, hashes, bounds) of some rows at a time."""
    reside("ngrams")
    for batch in batches:
        data, offsets = text_buffers(batch.column(column))
        lo = 0
        while lo < batch.num_rows:
            hi = min(lo + BATCH, int(np.searchsorted(offsets, offsets[lo] + BATCH_TEXT, side="right")) - 1, batch.num_rows)
            hi = max(lo + 1, hi)
            yield batch.slice(lo, hi - lo), *shingle_sets(data, offsets[lo : hi + 1], n)
            lo = hi


def _slots(hashes: np.ndarray, slots: int) -> np.ndarray:
    """Positions in a table of slots, a power of two."""
    return (hashes >> np.uint64(64 - slots.bit_length() + 1)).astype(np.int64)


def gram_counts(docs: DataFrame, n: int) -> np.ndarray:
    """A byte for each slot: 8 * log2(1 + documents that have an n-gram there).

    Each task sends chunks of its counters, which are added up over all shuffle
    partitions; the driver gets the sums as bytes.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).head()["b"] or 0
    slots = min(MOST_SLOTS, max(LEAST_SLOTS, 1 << (int(size) // SLOT_BYTES).bit_length()))

    def count(batches):
        low = np.zeros(slots, np.uint16)
        for _, hashes, _ in _sets(batches, 0, n):
            slot, times = np.unique(_slots(hashes, slots), return_counts=True)
            low[slot] = np.minimum(low[slot] + times, 65535)
        for lo in range(0, slots, CHUNK):
            part = low[lo : lo + CHUNK]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([lo // CHUNK], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])
        del low
        release()

    def merge(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(zlib.decompress(packed.as_py()), np.uint16)
                totals[chunk] = totals.get(chunk, 0) + part.astype(np.int64)
        for chunk, total in totals.items():
            coded = np.minimum(8 * np.log2(1.0 + total), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([zlib.compress(coded.tobytes(), 1)], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    merged = docs.select("text").mapInArrow(count, schema).repartition("chunk").mapInArrow(merge, schema)
    counts = np.zeros(slots, np.uint8)
    for row in merged.collect():  # slots bytes at most
        part = np.frombuffer(zlib.decompress(row["counts"]), np.uint8)
        counts[row["chunk"] * CHUNK : row["chunk"] * CHUNK + len(part)] = part
    return counts


def _fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each set."""
    size = np.diff(bounds)
    out = np.zeros(len(size), np.uint64)
    full = np.flatnonzero(size)
    with np.errstate(over="ignore"):
        if len(full):
            out[full] = np.add.reduceat(_mix(hashes + np.uint64(0x632BE59BD9B4E019)), bounds[:-1][full])
        return _mix(out + size.astype(np.uint64))


def needed(a, b, num: int, den: int):
    """Smallest overlap of linking sets of a and b elements: den * overlap >= num * union."""
    return -(-num * (a + b) // (num + den))


def _described(docs: DataFrame, n: int, num: int, den: int, counts) -> DataFrame:
    """(doc_id, mark, size, node, head): set size, fingerprint (null: empty set) and the rarest n-grams."""

    def run(batches):
        rank = counts.value
        for part, hashes, bounds in _sets(batches, 2, n):
            size = np.diff(bounds)
            node = _fingerprints(hashes, bounds).view(np.int64)
            heads = []
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = hashes[lo:hi]
                k = min(hi - lo, hi - lo + (-num * (hi - lo) // den) + SHARED)
                order = np.argsort(rank[_slots(own, len(rank))], kind="stable")[:k]  # ties by hash: own is sorted
                heads.append(own[order].view(np.int64))
            ends = np.concatenate(([0], np.cumsum([len(h) for h in heads])))
            head = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(heads) if heads else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size.astype(np.int64)), pa.array(node, mask=size == 0), head], names=["doc_id", "mark", "size", "node", "head"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "mark", "text").mapInArrow(run, f"doc_id {kind}, mark long, size long, node long, head array<long>")


def _candidate_edges(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (src, dst) of nodes such that no link leaves a connected component."""
    ratio = num / den
    rows = classes.select("node", "size", F.explode("head").alias("gram"))
    lists = cut(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
    met = cut(rows.join(_maybe_broadcast(lists, lists.count()), "gram"))

    group = met.where(F.col("m") <= LIST).groupBy("gram").agg(F.sort_array(F.collect_list(F.struct("node", "size"))).alias("l"))  # at most LIST

    def partners(x, i):
        after = F.slice(F.col("l"), i + 2, F.size("l"))
        fits = F.filter(after, lambda y: (F.least(x["size"], y["size"]) * den >= F.greatest(x["size"], y["size"]) * num) & (x["node"] != y["node"]))
        return F.transform(fits, lambda y: F.struct(x["node"].alias("src"), y["node"].alias("dst"), (x["size"] + y["size"]).alias("both")))

    pairs = group.select(F.explode(F.flatten(F.transform("l", partners))).alias("p")).select("p.*")
    overlap = F.ceil(F.col("both") * num / (num + den))
    pairs = pairs.groupBy("src", "dst", "both").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= F.least(F.lit(SHARED), overlap)).select("src", "dst")

    # sizes of linking sets differ by the ratio at most, so their classes are equal or neighbours
    level = F.floor(F.log(F.col("size").cast("double")) / -np.log(ratio) + 1e-9).cast("long") if ratio < 1 else F.col("size")
    long = met.where(F.col("m") > LIST).select("gram", "node", F.explode(F.array(level, level + 1)).alias("level"))
    leader = long.groupBy("gram", "level").agg(F.min("node").alias("dst")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = long.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))  # a list of any length is dealt out
    stars = salted.join(leader, ["gram", "level", "salt"]).where("node <> dst").select(F.col("node").alias("src"), "dst")
    return pairs.unionByName(stars).distinct()


class _Trie:
    """Globally ordered sets with shared beginnings: a compressed trie.

    A node is (segment, smallest and largest set size below, depth at its end, children, ids that end here).
    """

    def __init__(self, sets: list[np.ndarray], ids: list[int]):
        """sets: sorted arrays of local n-gram numbers."""
        self.root = self._build(list(zip(sets, ids, strict=True)), 0)

    def _build(self, items: list[tuple[np.ndarray, int]], depth: int):
        """The node of items, which agree up to depth; its segment is what they share further on."""
        first = items[0][0]
        low = min(len(s) for s, _ in items)
        share = low
        for s, _ in items[1:]:
            differ = np.flatnonzero(s[depth:share] != first[depth:share])
            if len(differ):
                share = depth + int(differ[0])
        branches: dict[int, list] = {}
        here = []
        for s, i in items:
            if len(s) == share:
                here.append(i)
            else:
                branches.setdefault(int(s[share]), []).append((s, i))
        kids = [self._build(part, share) for _, part in sorted(branches.items())]
        return first[depth:share], low, max(len(s) for s, _ in items), share, kids, here

    def links(self, own: np.ndarray, width: int, num: int, den: int, skip) -> Iterator[int]:
        """Ids of the sets that link with own; skip(id) spares known ones."""
        member = np.zeros(width, bool)
        member[own] = True
        a = len(own)
        stack = [(self.root, 0, 0)]
        while stack:
            (segment, low, high, depth, kids, here), overlap, used = stack.pop()
            if min(a, high) * den < num * max(a, low):
                continue  # no size in this subtree fits
            goal = needed(a, max(low, -(-num * a // den)), num, den)
            if overlap + min(a - used, high - (depth - len(segment))) < goal:
                continue
            if len(segment):
                overlap += int(np.count_nonzero(member[segment]))
                used = int(np.searchsorted(own, segment[-1], side="right"))
                if overlap + min(a - used, high - depth) < goal:
                    continue
            if here and overlap >= needed(a, depth, num, den):
                for i in here:
                    if not skip(i):
                        yield i
            stack += [(kid, overlap, used) for kid in kids]


def _forest(nodes: list[int], parts: list[int], sides: list[int], sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the two sides, or among all if there is one; sets of one part count as linked."""
    if len(nodes) < 2:
        return []
    every = np.unique(np.concatenate(sets))
    local = [np.searchsorted(every, s) for s in sets]
    first: dict[int, int] = {}
    parent = [first.setdefault(p, k) for k, p in enumerate(parts)]

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    stored = [k for k, s in enumerate(sides) if s == 0]
    probes = [k for k, s in enumerate(sides) if s == 1] or stored
    if not stored:
        stored = probes
    trie = _Trie([local[k] for k in stored], stored)
    found = []
    for k in probes:
        for i in trie.links(local[k], len(every), num, den, lambda i, k=k: root(i) == root(k)):
            a, b = root(i), root(k)
            if a != b:
                parent[a] = b
                found.append((nodes[i], nodes[k]))
    return found


def _spelt(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """(node, grams) of members (node, doc_id, mark, ...): the sets of one document a node, as bytes."""
    at = members.select("node", F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"))
    found = docs.join(_maybe_broadcast(at, members.count()), docs["doc_id"].eqNullSafe(at["__id"]) & docs["mark"].eqNullSafe(at["__mark"])).select("node", "text")

    def spell(batches):
        for part, hashes, bounds in _sets(batches, 1, n):
            grams = pa.array([hashes[lo:hi].tobytes() for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), grams], names=["node", "grams"])

    return found.mapInArrow(spell, "node long, grams binary")


def _solve(num: int, den: int):
    """A cell's forest; its rows are (node, part, side, grams), and sets of one part are known to be connected."""

    def run(cell: pa.Table) -> pa.Table:
        rows = {}  # by node: rows of a document may be repeated
        for node, part, side, grams in zip(*(cell[c].to_pylist() for c in ("node", "part", "side", "grams")), strict=True):
            rows.setdefault(node, (part, side, grams))
        sides = [x[1] for x in rows.values()]
        whole = cell["low"][0] == cell["high"][0]
        links = _forest(list(rows), [x[0] for x in rows.values()], sides, [np.frombuffer(x[2], np.uint64) for x in rows.values()], num, den) if whole or 0 < sum(sides) < len(sides) else []
        return pa.table([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["src", "dst"])

    return run


def _links(docs: DataFrame, members: DataFrame, clusters: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(src, dst): a forest of the links of every group.  members: (node, size, doc_id, mark) of one document a node."""
    solve, pairs = _solve(num, den), "src long, dst long"
    inside = cut(members.join(clusters, "node"))
    total = inside.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("grams"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    inside = cut(inside.join(total.select("component", "m", blocks.alias("blocks")), "component"))
    sets = cut(_spelt(docs, inside, n).join(inside.select("node", "component", "m", "blocks", "size"), "node"))

    # each set in its block, a few in all blocks of their group
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pivot = F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("m")) < PIVOTS
    at = F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own)))
    cells = sets.select("node", F.col("node").alias("part"), "grams", "component", at.alias("low"), F.lit(0).alias("side")).withColumn("high", F.col("low"))
    near = cut(cells.groupBy("component", "low", "high").applyInArrow(solve, pairs))

    large = sets.where("blocks > 1")
    if large.isEmpty():
        return near
    found = cut(connected_components(near).select("node", F.col("component").alias("part")))
    forget(docs.sparkSession)
    large = large.select("node", "grams", "size", "component").join(found, "node", "left").withColumn("part", F.coalesce("part", "node"))
    parts = cut(large.groupBy("component", "part").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("grams")))
    # bins of a group: a large part has its own, small parts share the others
    bins = F.greatest(F.ceil(F.col("m") / BLOCK_SETS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")
    alone = (F.col("m") * 2 >= BLOCK_SETS) | (F.col("grams") * 2 >= BLOCK_GRAMS)
    apart = parts.groupBy("component").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select("component")
    open_ = parts.join(apart, "component").withColumn("alone", alone)
    shared = open_.where(~F.col("alone")).groupBy("component").agg(F.sum("m").alias("m"), F.sum("grams").alias("grams")).select("component", bins.alias("bins"))
    placed = cut(open_.where("alone").select("component", "part", "alone", bins.alias("bins")).unionByName(open_.where(~F.col("alone")).join(shared, "component").select("component", "part", "alone", "bins")))
    bin_ = F.struct("alone", F.when(F.col("alone"), F.col("part")).alias("of"), "k")
    every = placed.select("component", "alone", F.when(F.col("alone"), F.col("part")).alias("part"), "bins").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    every = cut(every.select("component", bin_.alias("other")))
    key = F.when(F.col("alone"), F.xxhash64("node")).otherwise(F.xxhash64("part"))
    mine = large.join(placed, ["component", "part"]).withColumn("k", F.pmod(key, F.col("bins")).cast("int")).select("node", "part", "grams", "component", bin_.alias("own"))
    met = mine.join(_maybe_broadcast(every, every.count() * 2), "component").where("not (own.alone and other.alone and own.of = other.of)")
    cells = met.select("node", "part", "grams", "component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    return near.unionByName(cells.groupBy("component", "low", "high").applyInArrow(solve, pairs))


def _joined(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, mark, n_shingles, component, component_id) of every row of docs (doc_id, mark, text); component: null for an empty set."""
    counts = docs.sparkSession.sparkContext.broadcast(gram_counts(docs, n))
    release()
    rows = cut(_described(docs, n, num, den, counts))
    filled = rows.where("node is not null")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark"))
    classes = cut(filled.groupBy("node").agg(one.alias("one"), F.first("size").alias("size")).select("node", "size", "one.doc_id", "one.mark"))
    heads = filled.dropDuplicates(["node"]).select("node", "size", "head")
    edges = cut(_candidate_edges(heads, num, den))
    forget(docs.sparkSession)
    clusters = cut(connected_components(edges).select("node", "component"))
    forget(docs.sparkSession)
    links = cut(_links(docs, classes, clusters, n, num, den))
    forget(docs.sparkSession)
    found = cut(connected_components(links))
    forget(docs.sparkSession)
    least = classes.select("node", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = least.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = least.join(names, "component").select("node", "component", "component_id")
    out = rows.select("doc_id", "mark", F.col("size").alias("n_shingles"), "node").join(named, "node", "left")
    return out.select("doc_id", "mark", "n_shingles", "component", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, mark, text): mark tells apart the texts of one id."""
    return texts_of(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))


def jaccard_join(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Two documents link when den * intersection >= num * union of their sets of
    word n-grams (shingles.py); component_id is the smallest id reachable by
    links, its own included.  A null or wordless text has the empty set, links
    with nothing and is its own component.  Rows that repeat an id are documents
    of their own; a null id is never the smallest unless all are.  Other columns are
    not read; an empty table gives no rows.
    Sets and n-grams are told apart by 64-bit hashes.
    """
    return _joined(_marked(docs, id_col, text_col), n, num, den).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each component of jaccard_join.

    Rows are told apart by id and text, never by id alone: the row that stays is
    that of the smallest id (null last), among texts of that id the one of smallest
    hash, and of rows that agree in both any one.  Null and wordless texts all
    stay, as do rows without a link, whatever rows share their id.  Columns stay.
    """
    joined = cut(_joined(_marked(docs, id_col, text_col), n, num, den).where("n_shingles > 0"))
    texts = joined.groupBy("doc_id", "mark").agg(F.first("component").alias("component"), F.count(F.lit(1)).alias("times"))
    texts = cut(texts.withColumn("key", F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "mark")))
    kept = texts.groupBy("component").agg(F.min("key").alias("stays"))
    judged = cut(texts.join(kept, "component").withColumn("stays", F.col("key") == F.col("stays")).where("not stays or times > 1").select("doc_id", "mark", "stays"))
    id_, mark, stays = (unused(docs, c) for c in ("id", "mark", "stays"))
    judged = judged.select(F.col("doc_id").alias(id_), F.col("mark").alias(mark), F.col("stays").alias(stays))
    same = docs[id_col].eqNullSafe(F.col(id_)) & (F.xxhash64(docs[text_col].cast("string")) == F.col(mark))
    found = docs.join(_maybe_broadcast(judged, judged.count()), same, "left").where(f"{stays} is null or {stays}")
    if judged.where(stays).isEmpty():
        return found.select(*docs.columns)
    again = found.where(stays).dropDuplicates([id_, mark])
    return found.where(f"{stays} is null").unionByName(again).select(*docs.columns)


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all documents: three words, 90 of 100.  Nulls, repeats and empty tables as in jaccard_join."""
    return jaccard_join(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM w),
u AS (SELECT doc_id, len(sh)::BIGINT AS n, unnest(sh) AS g FROM s),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id
        AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(x, y) AS (SELECT DISTINCT x, y FROM i UNION SELECT r.x, i.y FROM r JOIN i ON r.y = i.x)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, least(s.doc_id, coalesce(m.y, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT x, min(y) AS y FROM r GROUP BY x) m ON m.x = s.doc_id
"""
