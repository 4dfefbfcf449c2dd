"""Near-duplicate texts with small edits (problem 5).

Each distinct text (a class of equal word sequences) gets a 64-bit code, one bit of each of 64 min-hashes, whose Hamming distance
follows the Jaccard distance of the shingle sets, and band keys of three min-hashes each. A band key names a shard: the texts that share it.
No radius that keeps the pairs at the threshold prunes a tree over the whole code: unrelated codes lie 32 bits apart, give or take four, and pairs at the threshold
up to 24. So the tree of a shard holds a code of nine bits of its own, drawn for its band from min-hashes that the band does not use. Its children are keyed by their
integer Hamming distance to the parent, and a search follows only the edges within two bits: it visits under a twentieth as many nodes as a shard of 4,000 unrelated members
has members. A pair at the threshold shares a shard and lies within two bits there with probability 0.16; over 32 bands its recall, measured, is 0.99, and 0.999 at a similarity of 0.65. What a
tree finds must be within the radius of the whole code too, and is then verified by the exact Jaccard similarity of the shingle sets.

A tree of the whole corpus has no size bound, so no tree is broadcast: Spark shuffles the members of a shard to one task. A shard with more than `part_size`
members is passed on, and its tree is split in parts of bounded size, each searched by the whole shard.

Defined results: null, empty and short texts (under `min_words` words) have no partners; repeated rows of
an item count once; equal texts are partners with similarity 1; a null group equals no other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .words import WORD, mix, slices, word_hashes

_U = np.uint64
ROWS, BANDS, BITS = 3, 32, 64
#: Bits of a shard's tree codes, and how many of them may differ.
TREE_BITS, TREE_RADIUS = 9, 2
TREE_MASK = (1 << TREE_BITS) - 1


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    n = ROWS * BANDS
    rng = np.random.default_rng(20240615)
    return rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def _drawn() -> list[np.ndarray]:
    """For each band the min-hashes that its tree codes are made of, none of the band's own."""
    rng = np.random.default_rng(7)
    n = ROWS * BANDS
    return [rng.choice([k for k in range(n) if k // ROWS != j], TREE_BITS, replace=False) for j in range(BANDS)]


def shingle_hashes(words: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of all texts (each with at least `size` words), and where each text's begin."""
    n = np.array([len(w) for w in words], np.int64)
    h = word_hashes([x for w in words for x in w])
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    ends = np.cumsum(n)
    keep = np.ones(len(h), bool)
    for k in range(1, size):
        keep[ends - k] = False
    keep = keep[: len(out)]
    starts = np.concatenate([[0], np.cumsum(n - size + 1)[:-1]])
    return out[keep], starts


def signatures(texts: list[list[str]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x BANDS) and codes of texts, given as their words. The low TREE_BITS of a key are the tree code, the rest names the shard."""
    h, starts = shingle_hashes(texts, size)
    x = (h >> _U(32)).astype(np.uint32)
    a, b = _permutations()
    least = np.empty((len(a), len(texts)), np.uint32)
    for k in range(len(a)):
        least[k] = np.minimum.reduceat(x * a[k] + b[k], starts)
    place = np.arange(BITS, dtype=_U)[:, None]
    code = (((least[:BITS] >> np.uint32(7)) & np.uint32(1)).astype(_U) << place).sum(0, dtype=_U)
    bands, drawn = np.empty((len(texts), BANDS), _U), _drawn()
    for j in range(BANDS):
        key = np.full(len(texts), _U(j + 1), _U)
        for r in range(ROWS):
            key = mix(key * _U(0x9E3779B97F4A7C15) + least[ROWS * j + r].astype(_U))
        tree = np.zeros(len(texts), _U)
        for n, k in enumerate(drawn[j]):
            tree |= (mix(least[k].astype(_U) + _U(j + 1 << 32)) & _U(1)) << _U(n)
        bands[:, j] = key >> _U(TREE_BITS) << _U(TREE_BITS) | tree
    return bands.view(np.int64), code.view(np.int64)


class BKTree:
    """Codes by Hamming distance. A node is [code, members, children by distance]."""

    def __init__(self) -> None:
        self.root: list | None = None

    def add(self, code: int, member: int) -> None:
        """Insert `member`; members with one code share a node."""
        if self.root is None:
            self.root = [code, [member], {}]
            return
        node = self.root
        while True:
            d = (node[0] ^ code).bit_count()
            if d == 0:
                node[1].append(member)
                return
            child = node[2].get(d)
            if child is None:
                node[2][d] = [code, [member], {}]
                return
            node = child

    def within(self, code: int, radius: int) -> Iterator[int]:
        """Members whose code is at most `radius` away."""
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            d = (node[0] ^ code).bit_count()
            if d <= radius:
                yield from node[1]
            stack += [c for e, c in node[2].items() if d - radius <= e <= d + radius]


def radius_for(similarity: float) -> int:
    """The distance of whole codes that a pair at `similarity` stays within but for about one pair in 5,000 (3.5 standard deviations)."""
    p = (1 - similarity) / 2
    return round(BITS * p + 3.5 * (BITS * p * (1 - p)) ** 0.5)


class _Shard:
    """The members of a shard met so far, in a tree over their tree codes."""

    def __init__(self, name: object) -> None:
        self.name, self.tree = name, BKTree()
        self.keys: list[int] = []
        self.rids: list[int] = []
        self.codes: list[int] = []

    def near(self, key: int, code: int, radius: int) -> list[int]:
        """The members within both radii."""
        return [i for i in self.tree.within(key & TREE_MASK, TREE_RADIUS) if (self.codes[i] ^ code).bit_count() <= radius]

    def add(self, key: int, rid: int, code: int) -> None:
        """One more member."""
        self.tree.add(key & TREE_MASK, len(self.rids))
        self.keys.append(key)
        self.rids.append(rid)
        self.codes.append(code)


def _pairs_batch(left: list[int], right: list[int], over: list[tuple[int, int, int]]) -> pa.RecordBatch:
    """Pairs (key null), then members of shards that are too large (rid_b null)."""
    n, m = len(left), len(over)
    keys = pa.array([None] * n + [k for k, _, _ in over], pa.int64())
    codes = pa.array([None] * n + [c - (1 << 64) if c >> 63 else c for _, _, c in over], pa.int64())
    return pa.RecordBatch.from_arrays([keys, pa.array(left + [r for _, r, _ in over], pa.int64()), pa.array(right + [None] * m, pa.int64()), codes], ["key", "rid_a", "rid_b", "code"])


def _search_shards(radius: int, part_size: int):
    """Rows (key, rid, code) sorted by key and rid; yields the pairs of each shard up to `part_size` members, and the members of larger ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, large, last = _Shard(None), False, None
        for b in batches:
            if not b.num_rows:
                continue
            left: list[int] = []
            right: list[int] = []
            over: list[tuple[int, int, int]] = []
            keys = b.column("key").to_numpy()
            names = keys >> TREE_BITS
            # Most shards have one member: such rows need no tree, but the first and the last, whose shard may go on in the batch beside.
            other = names[1:] != names[:-1]
            alone = np.concatenate([[False], other]) & np.concatenate([other, [False]])
            at = np.flatnonzero(~alone)
            rids, codes = b.column("rid").to_numpy()[at].tolist(), b.column("code").to_numpy().view(_U)[at].tolist()
            for name, key, rid, code in zip(names[at].tolist(), keys[at].tolist(), rids, codes, strict=True):
                if name != shard.name:
                    shard, large, last = _Shard(name), False, None
                if rid == last:  # a class that several tasks signed
                    continue
                last = rid
                if large:
                    over.append((key, rid, code))
                    continue
                for j in shard.near(key, code, radius):
                    left.append(min(rid, shard.rids[j]))
                    right.append(max(rid, shard.rids[j]))
                shard.add(key, rid, code)
                if len(shard.rids) == part_size:
                    # All members go to the second pass; pairs that it finds again count once in the end.
                    large = True
                    over += zip(shard.keys, shard.rids, shard.codes, strict=True)
            yield _pairs_batch(left, right, over)

    return run


def _search_parts(radius: int):
    """Rows (shard, part, in_tree, key, rid, code) sorted by part, the members of the part's tree first; yields the pairs within the radii."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(None)
        for b in batches:
            left: list[int] = []
            right: list[int] = []
            codes = b.column("code").to_numpy().view(_U).tolist()
            for name, part, in_tree, key, rid, code in zip(*(b.column(c).to_pylist() for c in ("shard", "part", "in_tree", "key", "rid")), codes, strict=True):
                if (name, part) != shard.name:
                    shard = _Shard((name, part))
                for j in shard.near(key, code, radius):
                    other = shard.rids[j]
                    if in_tree or rid < other:
                        left.append(min(rid, other))
                        right.append(max(rid, other))
                if in_tree:
                    shard.add(key, rid, code)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["rid_a", "rid_b"])

    return run


def _jaccard(size: int, least: float):
    """Verifies (rid_a, rid_b, text_a, text_b) rows exactly."""

    def grams(t: str) -> set:
        w = words_of(t)
        return set(zip(*(w[k:] for k in range(size)), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, sims = [], []
            last, mine = None, set()
            for i, (x, y) in enumerate(zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist(), strict=True)):
                if x != last:
                    last, mine = x, grams(x)
                other = grams(y)
                both = len(mine & other)
                s = both / (len(mine) + len(other) - both)
                if s >= least:
                    keep.append(i)
                    sims.append(s)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("rid_a").take(rows), b.column("rid_b").take(rows), pa.array(sims, pa.float64())], ["rid_a", "rid_b", "similarity"])

    return run


def words_of(text: str) -> list[str]:
    """The words of a text."""
    return WORD.findall(text.lower())


def signed_items(items: DataFrame, key: str, group: str, text: str, size: int, min_words: int, held: int = 500_000) -> DataFrame:
    """(item, grp, rid, code, bands) of every row with enough words; rid stands for the sequence of its words.

    A task signs a class once while it remembers it (`held` classes); its other rows there have null code and bands, so copies without end add no band rows.
    """
    src = items.select(F.col(key).alias("item"), F.col(group).alias("grp"), F.col(text).alias("text")).where(F.col("item").isNotNull() & (F.length("text") >= 2 * min_words - 1))
    kinds = {f.name: f.dataType.simpleString() for f in src.schema}

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for b in slices(whole, 1000):
                words = [words_of(t) for t in b.column("text").to_pylist()]
                rows = [i for i, w in enumerate(words) if len(w) >= min_words]
                if not rows:
                    continue
                rid = [xxhash.xxh3_64_intdigest(" ".join(words[i])) for i in rows]
                fresh = []
                for k, r in enumerate(rid):
                    if r not in seen:
                        if len(seen) >= held:
                            seen.clear()
                        seen.add(r)
                        fresh.append(k)
                at = pa.array(rows)
                cols = [b.column("item").take(at), b.column("grp").take(at), pa.array(np.array(rid, _U).view(np.int64))]
                where = np.full(len(rows), -1)
                where[fresh] = np.arange(len(fresh))
                take = pa.array(where, mask=where < 0)
                if fresh:
                    bands, codes = signatures([words[rows[k]] for k in fresh], size)
                    lists = pa.FixedSizeListArray.from_arrays(pa.array(bands.ravel()), BANDS).cast(pa.list_(pa.int64()))
                    cols += [pa.array(codes).take(take), lists.take(take)]
                else:
                    cols += [pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cols, ["item", "grp", "rid", "code", "bands"])

    return src.mapInArrow(sign, f"item {kinds['item']}, grp {kinds['grp']}, rid bigint, code bigint, bands array<bigint>")


def candidate_pairs(signed: DataFrame, similarity: float, part_size: int = 4000) -> DataFrame:
    """Distinct (rid_a < rid_b) that a shard's tree finds within the radii. One shuffle brings band keys together; only the members of shards that are too large make another."""
    radius = radius_for(similarity)
    bands = signed.where("code is not null").select(F.explode("bands").alias("key"), "rid", "code")
    shard = F.shiftright("key", TREE_BITS)
    met = bands.repartition(shard).sortWithinPartitions("key", "rid")
    found = cut(met.mapInArrow(_search_shards(radius, part_size), "key bigint, rid_a bigint, rid_b bigint, code bigint"))
    pairs = found.where("key is null").select("rid_a", "rid_b")
    over = found.where("key is not null").select(shard.alias("shard"), "key", F.col("rid_a").alias("rid"), "code")
    parts = over.groupBy("shard").agg(F.ceil(F.count("*") / part_size).cast("int").alias("parts"))
    split = (
        over.join(parts, "shard")
        .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("shard", "part", "key", "rid", "code", (F.pmod(F.xxhash64("rid"), F.col("parts")) == F.col("part")).alias("in_tree"))
        .repartition("shard", "part")
        .sortWithinPartitions("shard", "part", F.desc("in_tree"))
    )
    return pairs.unionByName(split.mapInArrow(_search_parts(radius), "rid_a bigint, rid_b bigint")).distinct()


def similar_classes(items: DataFrame, key: str, text: str, own: DataFrame, pairs: DataFrame, size: int, similarity: float, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(rid_a, rid_b, similarity) of the pairs of different word sequences with at least `similarity`.

    The items whose texts the check needs are broadcast to the scan if they take `broadcast_bytes` at most, else the texts are shuffled to them.
    """
    asked = pairs.select(F.explode(F.array("rid_a", "rid_b")).alias("rid")).dropDuplicates()
    # One item stands for a class: chosen on narrow rows first, so copies of one text, however many, bring one text to the check.
    chosen = cut(own.join(asked, "rid").groupBy("rid").agg(F.min("item").alias("item")))
    taken = chosen.agg(F.sum(F.octet_length(F.col("item").cast("string")) + 64)).first()[0] or 0
    texts = items.select(F.col(key).alias("item"), F.col(text).alias("text")).join(F.broadcast(chosen) if taken <= broadcast_bytes else chosen, "item").select("rid", "text").dropDuplicates(["rid"])
    a, b = (texts.select(F.col("rid").alias(f"rid_{s}"), F.col("text").alias(f"text_{s}")) for s in "ab")
    both = pairs.join(a, "rid_a").join(b, "rid_b").select("rid_a", "rid_b", "text_a", "text_b")
    return both.mapInArrow(_jaccard(size, similarity), "rid_a bigint, rid_b bigint, similarity double")


def _classes(items: DataFrame, key: str, group: str, text: str, size: int, similarity: float, min_words: int) -> tuple[DataFrame, DataFrame]:
    """(item, grp, rid) of the items with enough words, and the links (rid_a, rid_b, similarity) between their classes."""
    signed = cut(signed_items(items, key, group, text, size, min_words))
    own = signed.select("item", "grp", "rid").dropDuplicates(["item"])
    return own, similar_classes(items, key, text, own, cut(candidate_pairs(signed, similarity)), size, similarity)


def near_duplicate_pairs(items: DataFrame, key: str, group: str, text: str, *, size: int = 3, similarity: float = 0.6, min_words: int = 20) -> DataFrame:
    """(`key`_a < `key`_b, similarity): items of different groups whose texts are alike.

    `min_words` must be at least `size`.
    """
    own, links = _classes(items, key, group, text, size, similarity, min_words)
    same = own.groupBy("rid").agg(F.count("*").alias("n")).where("n > 1").select(F.col("rid").alias("rid_a"), F.col("rid").alias("rid_b"), F.lit(1.0).alias("similarity"))
    a, b = (own.select(F.col("item").alias(f"item_{s}"), F.col("grp").alias(f"grp_{s}"), F.col("rid").alias(f"rid_{s}")) for s in "ab")
    both = links.unionByName(same).join(a, "rid_a").join(b, "rid_b").where(F.coalesce(F.col("grp_a") != F.col("grp_b"), F.lit(True)))
    ordered = both.where((F.col("rid_a") != F.col("rid_b")) | (F.col("item_a") < F.col("item_b")))
    # Links and items are distinct, so these rows are.
    return ordered.select(F.least("item_a", "item_b").alias(f"{key}_a"), F.greatest("item_a", "item_b").alias(f"{key}_b"), "similarity")


def near_duplicate_groups(items: DataFrame, key: str, group: str, text: str, *, size: int = 3, similarity: float = 0.6, min_words: int = 20) -> DataFrame:
    """(`key`, group_id): items that `near_duplicate_pairs` links, directly or through others; a group is named by its smallest item.

    Classes are grouped, not items, so copies add members and no links. Two linked classes are one group if they have items of two
    groups between them, for then each of their items has a partner.
    """
    own, links = _classes(items, key, group, text, size, similarity, min_words)
    own = cut(own)
    # A null group equals no other: it counts as two.
    classes = own.groupBy("rid").agg(F.min("item").alias("first"), F.min("grp").alias("low"), F.max("grp").alias("high"), F.count("*").alias("n"), F.count_if(F.col("grp").isNull()).alias("nulls"))
    classes = classes.withColumn("mixed", (F.col("low") != F.col("high")) | (F.col("nulls") >= 2) | ((F.col("nulls") == 1) & (F.col("n") > 1))).na.fill(False, ["mixed"])
    side = lambda s: classes.select(F.col("rid").alias(f"rid_{s}"), F.col("low").alias(f"low_{s}"), F.col("mixed").alias(f"mixed_{s}"))
    apart = F.col("mixed_a") | F.col("mixed_b") | F.coalesce(F.col("low_a") != F.col("low_b"), F.lit(True))
    edges = links.join(side("a"), "rid_a").join(side("b"), "rid_b").where(apart).select("rid_a", "rid_b")
    alone = classes.where("mixed").select(F.col("rid").alias("rid_a"), F.col("rid").alias("rid_b"))
    named = components(edges.unionByName(alone), "rid_a", "rid_b").withColumnsRenamed({"item": "rid"})
    first = named.join(classes.select("rid", "first"), "rid").groupBy("group").agg(F.min("first").alias("group_id"))
    return own.join(named, "rid").join(first, "group").select(F.col("item").alias(key), "group_id")


def components(links: DataFrame, a: str, b: str, rounds: int = 30) -> DataFrame:
    """(item, group): connected components of the links; a group is named by its smallest item.

    Every round each item takes the smallest name among its own, its neighbours' and their names' names, so the rounds needed
    grow with the logarithm of the longest chain; it stops when no name changes, and fails loudly if `rounds` do not suffice.
    """
    edges = cut(links.select(F.col(a).alias("x"), F.col(b).alias("y")).unionByName(links.select(F.col(b).alias("x"), F.col(a).alias("y"))).dropDuplicates())
    names = cut(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("item"), F.least("x", "y").alias("group")))
    for _ in range(rounds):
        near = edges.join(names.select(F.col("item").alias("y"), "group"), "y").select(F.col("x").alias("item"), "group")
        hooked = names.unionByName(near).groupBy("item").agg(F.min("group").alias("group"))
        jumped = hooked.join(hooked.select(F.col("item").alias("group"), F.col("group").alias("next")), "group", "left").select("item", F.least("group", F.coalesce("next", "group")).alias("group"))
        new = cut(jumped)
        moved = new.join(names.withColumnRenamed("group", "was"), "item").where("group <> was").limit(1).count()
        names = new
        if not moved:
            return names
    raise RuntimeError(f"groups did not settle in {rounds} rounds")
