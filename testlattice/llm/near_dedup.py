"""MinHash near-dedup with HyperMinHash sketches.

A document's set holds the hashes of its distinct five-word shingles. Its sketch has 256 buckets; a bucket keeps the least value of the set under a
permutation of its own, as a count of leading zeros and ten bits of mantissa, 16 bits in all. A permutation for each bucket, rather than one that deals
the hashes out to buckets, leaves no bucket empty, so that short texts are compared as well as long ones. Five neighbouring registers are a band, and
documents with an equal band are candidates.

Pairs within a group of candidates are never all made:

1. Documents with equal sets are one node, named by its smallest id; where rows share an id but not a set, its node has several sets, each with its sketch,
   and is linked by any of them. Bands that hold the same nodes are one group.
2. In every group each node is paired with one node, the pivot: the one whose own groups are largest in sum, which in a group of near copies is the text
   they were made from. Pairs that pass the collision-corrected estimate from the sketches are confirmed on the full sets; confirmed ones are links.
3. What can still be missed are links between nodes of one group in different components. They meet in tasks, in blocks of at most ``crowd`` nodes of common
   length (fewer long ones); larger groups are divided by size, so that only blocks meet whose sizes allow a link, and then by hash. There, at the first band
   that two nodes share, pairs that the estimate doesn't exclude are confirmed on the full sets, and one link for each two components becomes a row.

Bands miss a pair of similarity 0.75 with a probability of (1 - 0.75^5)^51, 1e-6; the estimate is held to exclude a pair when it is five standard deviations
below, 3e-7. Nothing else is left out, whatever the size of a group. All links are confirmed on full sets.

Defined results: null counts as empty; a text without words has an empty set and no links; with fewer than five words the whole
sequence is the only shingle; repeated rows are equal sets; rows that share an id are in one component, whatever their texts and their order; a null id
makes no link, and its row is told the component of its text, if another row has it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, give_back, map_batches, utf8
from .graph import components

WORDS, BUCKETS, ROWS, BANDS, MANTISSA = 5, 256, 5, 51, 10
CROWD, PLACE, SIGMAS, LEAST = 2048, 2048, 5.0, 0.75
_U = np.uint64
_rng = np.random.default_rng(20240)
_FACTOR = (_rng.integers(0, 1 << 31, BUCKETS, dtype=_U) * _U(2) + _U(1)).astype(np.uint32)[:, None]
_MASK = _rng.integers(0, 1 << 32, BUCKETS, dtype=_U).astype(np.uint32)[:, None]


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; bytes.lower and bytes.split know ASCII letters and white space alone."""
    found = text.lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, _U)
    if n < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=n)], _U)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, found), _U, n)
    out = own[: n - words + 1].copy()
    for i in range(1, words):
        out *= _U(0x9E3779B97F4A7C15)
        out += own[i : n - words + 1 + i]
    out ^= out >> _U(33)
    out *= _U(0xFF51AFD7ED558CCD)
    out ^= out >> _U(33)
    return np.unique(out)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """256 registers: leading zeros of the least value under a bucket's permutation in the upper six bits, its mantissa below."""
    part = (hashes >> _U(32)).astype(np.uint32)
    least = np.full(BUCKETS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(part), 512):
        np.minimum(least, ((part[None, i : i + 512] ^ _MASK) * _FACTOR).min(1), out=least)
    fraction, power = np.frexp(least.astype(np.float64) + 0.5)
    return (((32 - power) << MANTISSA) | ((fraction - 0.5) * (2 << MANTISSA)).astype(np.int64)).astype(np.uint16)


@functools.lru_cache(4096)
def _accident(n: float, m: float) -> float:
    """Probability that a register of two disjoint sets with n and m hashes is equal."""
    zeros = 2.0 ** -(np.arange(33) + 1)[:, None]
    low = zeros * (1 + np.arange(1 << MANTISSA) / (1 << MANTISSA))
    high = low + zeros / (1 << MANTISSA)
    return float(((np.exp(-n * low) - np.exp(-n * high)) * (np.exp(-m * low) - np.exp(-m * high))).sum())


def corrected(same: int, n: int, m: int) -> tuple[float, float]:
    """Jaccard similarity from the number of equal registers, without those equal by accident, and its standard deviation at 0.75."""
    near = lambda x: 2.0 ** (round(4 * np.log2(max(x, 1))) / 4)
    by_chance = _accident(near(n), near(m)) * BUCKETS
    return max(0.0, (same - by_chance) / (BUCKETS - by_chance)), float(np.sqrt(LEAST * (1 - LEAST) / BUCKETS))


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> tuple[float, float]:
    """Jaccard similarity of sets of n and m hashes from their sketches, corrected for accidental equality, and its standard deviation at 0.75."""
    return corrected(int((a == b).sum()), n, m)


def similarity(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and the union of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    both = int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
    return both, len(a) + len(b) - both


def _marks(rows: DataFrame) -> DataFrame:
    """(_id, n, digest of the set, sketch) of every row."""
    id_type = rows.schema["_id"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x) for x in utf8(batch, "_text")]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("_id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            ],
            ["_id", "n", "digest", "sketch"],
        )

    return map_batches(rows, work, f"_id {id_type}, n long, digest binary, sketch binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(key, node) for each band: a 64-bit name of its registers, with the band's number in the lowest six bits."""
    node_type = nodes.schema["node"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        grid = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        bands = np.ascontiguousarray(grid[:, : ROWS * BANDS]).reshape(-1, BANDS, ROWS)
        four = np.ascontiguousarray(bands[:, :, :4]).view(_U)[:, :, 0]
        keys = (four ^ (bands[:, :, 4].astype(_U) * _U(0xC2B2AE3D27D4EB4F))) * _U(0x9E3779B97F4A7C15)
        keys ^= keys >> _U(29)
        keys *= _U(0xBF58476D1CE4E5B9)
        keys = (keys & ~_U(63)) | np.arange(BANDS, dtype=_U)
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).reshape(-1)), batch.column("node").take(pa.array(np.repeat(np.arange(len(grid)), BANDS)))], ["key", "node"])

    return map_batches(nodes.select("node", "sketch"), work, f"key long, node {node_type}")


def _groups(nodes: DataFrame) -> DataFrame:
    """(key, size, node) of bands that several nodes share; of bands with the same nodes only the first stands."""
    # only a node of several sets can hold a band twice; such nodes are rare, and most tables have none
    several = cut_lineage(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("node"))
    if several.isEmpty():
        every = _bands(nodes).repartition("key")
    else:
        every = _bands(nodes.join(several, "node", "left_anti")).unionByName(_bands(nodes.join(several, "node", "left_semi")).distinct()).repartition("key")
    own = every.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("node").alias("first"), F.max("node").alias("last")).where("size > 1")
    names = own.groupBy("size", "x", "y", "first", "last").agg(F.min(F.struct(F.col("key").bitwiseAND(63).alias("band"), "key")).alias("k")).select("k.key", "size")
    return every.join(names, "key")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the estimate does not exclude."""
    own = nodes.select("node", "n", "sketch")
    both = pairs
    for side in ("a", "b"):
        both = both.join(own.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"s_{side}")), side)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, t = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in ("s_a", "s_b"))
        sizes = zip((s == t).sum(1).tolist(), batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist(), strict=True)
        take = [i for i, (same, n, m) in enumerate(sizes) if _open(same, n, m)]
        return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(take, pa.int32())) for c in ("a", "b")], ["a", "b"])

    return map_batches(both, work, pairs.select("a", "b").schema)


def _open(same: int, n: int, m: int) -> bool:
    if min(n, m) < LEAST * max(n, m):
        return False
    value, sd = corrected(same, n, m)
    return value + SIGMAS * sd >= LEAST


def _sets(rows: DataFrame) -> DataFrame:
    """(node, digest, set) of rows (node, _text): the sorted hashes, 8 bytes each."""
    node_type = rows.schema["node"].dataType.simpleString()

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(x).tobytes() for x in utf8(batch, "_text")]
        return pa.RecordBatch.from_arrays([batch.column("node"), pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], ["node", "digest", "set"])

    return map_batches(rows, work, f"node {node_type}, digest binary, set binary")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are as similar as a link needs."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("s_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("s_b")), "b")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        take = []
        for i, (x, y) in enumerate(zip(batch.column("s_a").to_pylist(), batch.column("s_b").to_pylist(), strict=True)):
            common, every = similarity(np.frombuffer(x, _U), np.frombuffer(y, _U))
            if 100 * common >= 75 * every:
                take.append(i)
        return pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(take, pa.int32())) for c in ("a", "b")], ["a", "b"])

    return map_batches(both, work, pairs.select("a", "b").schema)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``n_shingles``, ``component_id``, ``kept``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    marks = cut_lineage(_marks(rows))
    classes = marks.where("digest is not null and _id is not null").groupBy("digest").agg(F.min("_id").alias("node"))
    members = cut_lineage(marks.select("_id", "n", "digest").join(classes, "digest", "left").select("_id", "n", F.coalesce("node", "_id").alias("node")))
    nodes = cut_lineage(marks.join(classes.withColumnRenamed("digest", "_d"), (F.col("digest") == F.col("_d")) & (F.col("_id") == F.col("node"))).select("node", "digest", "n", "sketch").dropDuplicates(["node", "digest"]))
    del marks, classes

    held = cut_lineage(_groups(nodes))
    own = held.select("node").distinct()
    nodes = cut_lineage(nodes.join(own, "node", "left_semi"))
    sets = cut_lineage(_sets(rows.withColumnRenamed("_id", "node").join(own, "node", "left_semi")).dropDuplicates(["node", "digest"]))

    popular = held.groupBy("node").agg(F.sum("size").alias("known"))
    pivots = held.join(popular, "node").groupBy("key").agg(F.max(F.struct("known", "node")).alias("p")).select("key", F.col("p.node").alias("pivot"))
    pairs = held.join(pivots, "key").where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()
    # the sets of one id may be those of other nodes
    least = members.where("_id is not null").groupBy("_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("_id", "a")
    same_id = members.join(least, "_id").select("a", F.col("node").alias("b")).where("a <> b")
    links = cut_lineage(_links(_likely(pairs, nodes).distinct(), sets).distinct().unionByName(same_id))
    labels = components(links)
    more = cut_lineage(_apart(held, labels, nodes.join(sets, ["node", "digest"]), crowd))
    if not more.isEmpty():
        labels = components(links.union(more))

    out = members.join(labels, "node", "left").select(F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def _apart(held: DataFrame, labels: DataFrame, nodes: DataFrame, crowd: int) -> DataFrame:
    """Links (a, b) between nodes that share a group and are in different components: at least one for any two components that have one there.

    A group goes to one place, a larger one to a place for every two of its blocks: nodes of like size, of at most about ``crowd`` times PLACE bytes. The rows of
    a place follow each other in one task, which holds one place at a time.
    """
    node_type = nodes.schema["node"].dataType.simpleString()
    placed = held.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 <> c1").select("key")
    mine = placed.join(mixed, "key", "left_semi").join(nodes, "node").withColumn("cost", 8 * F.col("n") + 600)
    large = mine.groupBy("key").agg(F.sum("cost").alias("whole")).where(F.col("whole") > PLACE * crowd).select("key", F.lit(True).alias("large"))
    like = F.when(F.col("large"), F.floor(F.log("n") / np.log(4 / 3))).otherwise(F.lit(0)).cast("int")
    mine = mine.join(large, "key", "left").withColumn("like", like)
    parts = mine.where("large").groupBy("key", "like").agg(F.ceil(F.sum("cost") / (PLACE * crowd)).cast("int").alias("parts"))
    blocks = parts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("like", "parts"))).alias("blocks"))
    mine = mine.join(blocks, "key", "left")
    count = lambda d: F.coalesce(F.try_element_at("blocks", F.col("like") + d), F.lit(0 if d else 1))
    mine = mine.withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), count(0)).cast("int"))
    place = lambda b, c, d, e: F.struct(b.alias("b"), c.alias("c"), d.alias("d"), e.alias("e"))
    own, at = F.col("like"), F.col("block")
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    slots = F.concat(
        F.transform(upto(count(0)), lambda i: place(own, F.least(at, i), own, F.greatest(at, i))),
        F.transform(upto(count(1)), lambda i: place(own, at, own + 1, i)),
        F.transform(upto(count(-1)), lambda i: place(own - 1, i, own, at)),
    )
    side = lambda b, c: ((own == F.col(f"slot.{b}")) & (at == F.col(f"slot.{c}")))
    dealt = mine.withColumn("slot", F.explode(slots)).select("key", F.xxhash64("slot").alias("at"), "node", "component", "n", "sketch", "set", side("b", "c").alias("left"), side("d", "e").alias("right"))
    dealt = dealt.repartition("key", "at").sortWithinPartitions("key", "at")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # parts of the last place
        last = None
        kind = None

        def compare(parts: list[pa.RecordBatch], key: int) -> list[tuple]:
            return _side_by_side(key & 63, pa.Table.from_batches(parts))

        for batch in batches:
            out: list[tuple] = []
            kind = batch.schema.field("node").type
            keys, at = (batch.column(c).to_numpy() for c in ("key", "at"))
            starts = [0, *(np.flatnonzero((np.diff(keys) != 0) | (np.diff(at) != 0)) + 1).tolist(), len(keys)]
            for a, b in zip(starts, starts[1:]):
                place = (int(keys[a]), int(at[a]))
                if place != last and held:
                    out += compare(held, last[0])
                    held.clear()
                last = place
                held.append(batch.slice(a, b - a))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i in range(2)], ["a", "b"])
        if held:
            out = compare(held, last[0])
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i in range(2)], ["a", "b"])
        give_back()

    return dealt.mapInArrow(work, f"a {node_type}, b {node_type}").distinct()


def _side_by_side(band: int, group: pa.Table) -> list[tuple]:
    """Links of a place, between nodes of its left block and nodes of its right one, that join components."""
    if group.num_rows < 2:
        return []
    nodes, names = group.column("node").to_pylist(), group.column("component").to_pylist()
    sizes = np.array(group.column("n").to_pylist())
    grid = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
    sets = [np.frombuffer(x, _U) for x in group.column("set").to_pylist()]
    left, right = (np.array(group.column(x).to_pylist(), bool) for x in ("left", "right"))
    numbers = {c: i for i, c in enumerate(dict.fromkeys(names))}
    own = np.array([numbers[c] for c in names])
    place = np.arange(len(own))
    fewest = int(BUCKETS * (LEAST - SIGMAS * np.sqrt(LEAST * (1 - LEAST) / BUCKETS)))  # fewer equal registers exclude a pair whatever the accidents
    out = []
    for i in np.flatnonzero(left).tolist():
        others = np.flatnonzero(right & (own != own[i]) & (sizes >= LEAST * sizes[i]) & (LEAST * sizes <= sizes[i]) & ~(left & right[i] & (place < i)))
        if not len(others):
            continue
        same = (grid[others] == grid[i]).sum(1)
        near = np.flatnonzero(same >= fewest)
        near = near[np.argsort(-same[near], kind="stable")]
        others, same = others[near], same[near]
        shared = (grid[others, : ROWS * BANDS] == grid[i, : ROWS * BANDS]).reshape(-1, BANDS, ROWS).all(2)
        others = [j for j, count, first in zip(others.tolist(), same.tolist(), shared.argmax(1).tolist(), strict=True) if first == band and _open(count, int(sizes[i]), int(sizes[j]))]
        if not others:
            continue
        joined = np.concatenate([sets[j] for j in others])
        hits = sets[i][np.minimum(np.searchsorted(sets[i], joined), len(sets[i]) - 1)] == joined
        both = np.add.reduceat(hits, np.append(0, np.cumsum(sizes[others])[:-1]), dtype=np.int64)
        for j in (j for j, common in zip(others, both.tolist(), strict=True) if 100 * common >= 75 * (sizes[i] + sizes[j] - common)):
            if own[j] != own[i]:
                own[own == own[j]] = own[i]
                out.append((nodes[i], nodes[j]))
    return out
