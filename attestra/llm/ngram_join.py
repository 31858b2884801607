"""N-gram Jaccard join by parity sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.components import connected_components
from attestra.llm.storage import Scratch, keep_possible, key_bitmap, without_keys
from attestra.llm.text import small_slices
from attestra.shipping import ship_package

#: Words of a shingle. Two sets link when 4 * intersection >= 3 * union; what follows from that ratio is in `candidates`.
SHINGLE = 5
#: Blocks that a size band's sketch is cut into, as a share of the largest size in the band.
BLOCKS = 0.4
#: A shingle is common when so many different sets of a stretch of COMMON_STRETCH shingles hold it; so many common ones are sent out.
COMMON_IN_STRETCH, COMMON_STRETCH, COMMON_SENT = 6, 1_000_000, 500_000
#: Signatures that a task gathers before it deals them out.
DEALT = 400_000
#: A signature that so many of these sets hold is dealt out, in pieces of as many rows, over up to SALTS tasks (a power of two).
HOT, SALTS = 64, 1_024
#: Rounds in which each node left is compared with its nearest partner of one signature.
NEAREST = 2
#: Pairs of a signature up to which they are made in a join; larger ones are screened in blocks of at most BLOCK_ROWS nodes.
SMALL, BLOCK_ROWS = 64, 2_048
#: Signatures of a node, the least ones, by which a pair that shares several is told at the least of them alone.
LEAST = 12
#: Sizes of linked sets are as 3 to 4 at most.
SIZES_ALLOW = "4 * least({0}, {1}) >= 3 * greatest({0}, {1})"
#: Members of a star that one task compares with the star's centre.
STAR = 256
#: Words whose hash a task remembers, and sets of which it knows that it has sent them.
CACHE, SEEN = 50_000, 200_000

_ODD = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
MULTIPLIERS = np.array(_ODD, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit hash, remembered for CACHE words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = h
        return h


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's shingles; a text of fewer words than SHINGLE has one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(len(w), SHINGLE)
    total = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        total += w[j : len(w) - n + 1 + j] * MULTIPLIERS[j]
    return np.unique(mix(total))


def dense_sketch(s: np.ndarray) -> np.ndarray:
    """Bit i: the parity of the number of shingles that hash to i. Sets differ in at least as many shingles as bits.

    The sketch has two to four times the set's size as bits, 128 at least, so few of two sets' differences fall together.
    One of twice the bits folds to the smaller one by the exclusive or of its halves.
    """
    bits = max(128, 2 << len(s).bit_length())
    counts = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.int64)


class _Seen(set):
    """Nodes that a task has sent, SEEN at most; what is forgotten is sent again, which does no harm."""

    def first(self, node: int) -> bool:
        if node in self:
            return False
        if len(self) >= SEEN:
            self.clear()
        self.add(node)
        return True


DESCRIBED = "doc_id long, mark long, n long, node long, sketch array<long>, common long"


def _described(ids, marks, n, nodes, sketches, common) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            ids,
            marks,
            pa.array(n, pa.int64()),
            pa.array(nodes, pa.int64()),
            pa.array(sketches, pa.list_(pa.int64())),
            pa.array(common, pa.int64()),
        ],
        names=["doc_id", "mark", "n", "node", "sketch", "common"],
    )


def _common(sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows (node, common) of shingles that COMMON_IN_STRETCH of the sets hold."""
    width = np.uint64((1 << 20) - 1)
    every = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    heavy = np.bincount((every & width).astype(np.int64), minlength=int(width) + 1) >= COMMON_IN_STRETCH
    found, times = np.unique(every[heavy[(every & width).astype(np.int64)]], return_counts=True)
    found, times = found[times >= COMMON_IN_STRETCH], times[times >= COMMON_IN_STRETCH]
    if len(found):
        none = [None] * len(found)
        yield _described(pa.array(none, pa.int64()), pa.array(none, pa.int64()), none, found.view(np.int64), none, times)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents, whose sketch is null where the task has sent that set's before, and rows (node, common) of
    shingles common in a stretch."""
    hashes, seen, every, held = WordHashes(), _Seen(), [], 0
    for whole in batches:
        for batch in small_slices(whole, 2):
            n, nodes, sketches = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), hashes)
                n.append(len(s))
                nodes.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None)
                new = len(s) > 0 and seen.first(nodes[-1])
                sketches.append(dense_sketch(s) if new else None)
                if new:
                    every.append(s)
                    held += len(s)
            yield _described(batch.column(0), batch.column(1), n, nodes, sketches, [None] * len(n))
            if held >= COMMON_STRETCH:
                yield from _common(every)
                every, held = [], 0
    yield from _common(every)


def _blocks(s: np.ndarray, k: int, tag: int, most: int) -> tuple[np.ndarray, bool]:
    """Signatures of the first `most` blocks that hold shingles, and whether there are so many.

    s is sorted, and block i of k holds the hashes from i / k to (i + 1) / k of their range, so blocks follow each other
    in s. A block's signature is the exclusive or of its shingles' hashes: the sparse form of its stretch of the parity
    sketch, in which each shingle flips the bit that it hashes to.
    """
    if not len(s):
        return s, False
    block = ((s >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    enough = len(starts) >= most
    end = starts[most] if len(starts) > most else len(s)
    starts = starts[:most]
    parity = np.bitwise_xor.reduceat(mix(s[:end] ^ np.uint64(0x5851F42D4C957F2D)), starts)
    return mix(parity ^ mix(block[starts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(tag))), enough


def signatures(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Signatures of a set, such that linked sets share one (see `candidates`). common: sorted hashes, may be empty."""
    n = len(s)
    if not n:
        return s
    need, band = n // 3 + 1, n.bit_length() - 1
    bands = [band, band + 1] if 4 * n // 3 >= 1 << (band + 1) else [band]
    rare = s
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        rare = s[common[at] != s]
    out = []
    for b in bands:
        k = int(np.ceil(BLOCKS * (1 << (b + 1))))
        got, enough = _blocks(rare, k, b * 4, need)
        out.append(got)
        if not enough:
            got, enough = _blocks(s, k, b * 4 + 1, need)
            out.append(got)
        if not enough:
            out.append(mix(s[:need] ^ mix(np.full(1, b * 4 + 2, dtype=np.uint64))))
    return np.concatenate(out)


def _dealt(sigs: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sig, node) of a batch, with a salt as the signature's lowest bits: 0, but for signatures that HOT nodes of the batch
    hold. Of those, stretches of HOT nodes get a salt each, and one node, the hub, goes to all these stretches and to salt
    0, so that all stay connected."""
    sigs = sigs & ~np.uint64(SALTS - 1)
    low = (sigs >> np.uint64(48)).astype(np.int64)
    heavy = np.flatnonzero((np.bincount(low, minlength=1 << 16) >= HOT)[low])
    if not len(heavy):
        return sigs, owner
    heavy = heavy[np.lexsort((owner[heavy], sigs[heavy]))]
    starts = np.flatnonzero(np.r_[True, sigs[heavy][1:] != sigs[heavy][:-1]])
    more = []
    for i, j in zip(starts.tolist(), [*starts[1:].tolist(), len(heavy)], strict=True):
        if j - i >= HOT:
            rows = heavy[i:j]
            hub = rows[0]
            first = mix(owner[hub : hub + 1].view(np.uint64))[0]
            salt = (first + (np.arange(j - i) // HOT).astype(np.uint64)) % np.uint64(SALTS - 1) + np.uint64(1)
            more += [(sigs[hub] | x, owner[hub]) for x in np.unique(salt)]
            sigs[rows[1:]] |= salt[1:]
    if more:
        sigs = np.concatenate([sigs, np.array([x[0] for x in more], dtype=np.uint64)])
        owner = np.concatenate([owner, np.array([x[1] for x in more], dtype=np.int64)])
    return sigs, owner


def _signed(common: np.ndarray):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen, sigs, nodes, held = WordHashes(), _Seen(), [], [], 0

        def dealt() -> Iterator[pa.RecordBatch]:
            if nodes:
                owner = np.repeat(np.array(nodes, dtype=np.int64), [len(x) for x in sigs])
                sig, owner = _dealt(np.concatenate(sigs), owner)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(owner)], names=["sig", "node"])

        for batch in (part for whole in batches for part in small_slices(whole, 0)):
            for text in batch.column(0):
                s = shingle_set(text.as_py(), hashes)
                node = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                if len(s) and seen.first(node):
                    sigs.append(signatures(s, common))
                    nodes.append(node)
                    held += len(sigs[-1])
            if held >= DEALT:
                yield from dealt()
                sigs, nodes, held = [], [], 0
        yield from dealt()

    return emit


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (salted sig, node): (sig, center, member), the center being the first node. Keeps one row."""
    last_sig = last_node = center = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sig, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        new = np.r_[sig[0] != last_sig, sig[1:] != sig[:-1]]
        again = ~new & (node == np.r_[node[0] if last_node is None else last_node, node[:-1]])
        begins = np.maximum.accumulate(np.where(new, np.arange(len(sig)), -1))
        centers = np.where(begins >= 0, node[np.maximum(begins, 0)], 0 if center is None else center)
        keep = ~new & ~again
        last_sig, last_node, center = sig[-1], node[-1], centers[-1]
        if keep.any():
            plain = sig[keep] & ~np.int64(SALTS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(plain), pa.array(centers[keep]), pa.array(node[keep])], names=["sig", "center", "member"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (a, part, b, text) sorted with a's own row (b null) first: (a, b) that link. Keeps one set."""
    hashes, key, own = WordHashes(), None, None
    for whole in batches:
        for batch in small_slices(whole, 3):
            left, right = [], []
            for a, part, b, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s = shingle_set(text, hashes)
                if b is None:
                    key, own = (a, part), s
                elif key == (a, part):
                    at = np.minimum(np.searchsorted(own, s), len(own) - 1)
                    shared = int((own[at] == s).sum())
                    if 4 * shared >= 3 * (len(own) + len(s) - shared):
                        left.append(a)
                        right.append(b)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (x, y) of nodes whose sizes and sketches allow a link."""
    for side in ("x", "y"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")).hint("merge"), side)
    near = pairs.filter(SIZES_ALLOW.format("n_x", "n_y"))
    fold = "IF(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, size({1}) + 1, size({1})), (p, q) -> p ^ q), {0})"
    x, y = fold.format("sketch_x", "sketch_y"), fold.format("sketch_y", "sketch_x")
    apart = F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (total, d) -> total + d)")
    return near.filter(7 * apart <= F.col("n_x") + F.col("n_y")).select("x", "y")


def _fold(sketches: np.ndarray, words: int) -> np.ndarray:
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _near(sig: int, own: list, other: list) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes of own and of other that may link, in different components, of allowed sizes, their sketches near enough, and
    how far apart these are as a share of both sizes.

    own and other: (node, n, label, sketch words, flat sketches, least signatures) by sketch length, so that each block is a
    matrix. A pair whose least signatures have one below this signature in common is met there, and left out here.
    """
    for an, ac, al, aw, ask, asig in own:
        for on, oc, ol, ow, osk, osig in other:
            if max(aw, ow) > 2 * min(aw, ow):
                continue
            words = min(aw, ow)
            a, o = _fold(ask, words), _fold(osk, words)
            step = max(1, (1 << 22) // max(1, len(o) * words))
            for i in range(0, len(a), step):
                ok = (al[i : i + step, None] != ol) & (4 * np.minimum(ac[i : i + step, None], oc) >= 3 * np.maximum(ac[i : i + step, None], oc))
                if not ok.any():
                    continue
                apart = np.bitwise_count(a[i : i + step, None, :] ^ o[None, :, :]).sum(axis=2, dtype=np.int64)
                both = ac[i : i + step, None] + oc
                x, y = np.nonzero(ok & (7 * apart <= both))
                if len(x) and asig.shape[1]:
                    first = np.ones(len(x), dtype=bool)
                    for k in range(0, len(x), 1 << 14):
                        here, there = asig[i : i + step][x[k : k + (1 << 14)]], osig[y[k : k + (1 << 14)]]
                        first[k : k + (1 << 14)] = ~((here[:, :, None] == there[:, None, :]) & (here[:, :, None] < sig)).any(axis=(1, 2))
                    x, y = x[first], y[first]
                if len(x):
                    yield an[i : i + step][x], on[y], apart[x, y] / both[x, y]


def _by_length(node: np.ndarray, n: np.ndarray, label: np.ndarray, flat: np.ndarray, starts: np.ndarray, words: np.ndarray, least: np.ndarray) -> list:
    """flat is unsigned: NumPy counts a negative number's bits on its absolute value."""
    out = []
    for w in np.unique(words):
        at = np.flatnonzero(words == w)
        out.append((node[at], n[at], label[at], int(w), flat[starts[at][:, None] + np.arange(int(w))], least[at]))
    return out


def _screen(nearest: bool):
    """From rows (sig, part, other, node, n, label, sketch, least), a part's own nodes (other = 0) before the ones that they meet:
    (x, y, apart) that may link, or for each own node x and batch the nearest such y alone. Keeps the own nodes of one part,
    BLOCK_ROWS on average at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, part, other, node, n, label = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            lists = batch.column(6)
            flat, offsets = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
            starts, words = offsets[:-1], np.diff(offsets)
            least = batch.column(7).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            new = np.flatnonzero(np.r_[True, (sig[1:] != sig[:-1]) | (part[1:] != part[:-1]) | (other[1:] != other[:-1])])
            found = []
            for i, j in zip(new, np.r_[new[1:], len(sig)], strict=True):
                block = _by_length(node[i:j], n[i:j], label[i:j], flat, starts[i:j], words[i:j], least[i:j])
                if other[i] == 0:
                    own = own + block if key == (sig[i], part[i]) else block
                    key = (sig[i], part[i])
                elif key == (sig[i], part[i]):
                    found += _near(sig[i], own, block)
            if found:
                x, y, apart = (np.concatenate(c) for c in zip(*found, strict=True))
                order = np.lexsort((y, apart, x)) if nearest else np.lexsort((y, x))
                x, y, apart = x[order], y[order], apart[order]
                first = np.r_[True, (x[1:] != x[:-1]) | (False if nearest else y[1:] != y[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(c[first]) for c in (x, y, apart)], names=["x", "y", "apart"])

    return run


def _blockwise(own: DataFrame, every: DataFrame, nodes: DataFrame, nearest: bool) -> DataFrame:
    """(x, y, apart) by _screen: own nodes (sig, node, part, parts) against every node of their signatures (sig, node, n, label)."""
    parts = own.select("sig", "parts").distinct()
    sketch = nodes.select("node", "sketch", F.array().cast("array<long>").alias("least"))
    if not nearest:
        padded = F.slice(F.concat(F.array_sort(F.collect_set("sig")), F.array_repeat(F.lit((1 << 63) - 1), LEAST)), 1, LEAST)
        least = every.groupBy("node").agg(padded.alias("least"))  # a node's signatures are a third of its shingles
        sketch = nodes.select("node", "sketch").join(least.hint("merge"), "node")
    one = own.join(sketch.hint("merge"), "node").withColumn("other", F.lit(0))
    met = every.join(parts.hint("merge"), "sig").join(sketch.hint("merge"), "node")
    met = met.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).withColumn("other", F.lit(1))
    order = ["sig", "part", "other", "node", "n", "label", "sketch", "least"]
    rows = one.select(*order).unionByName(met.select(*order)).repartition("sig", "part").sortWithinPartitions("sig", "part", "other")
    return rows.mapInArrow(_screen(nearest), "x long, y long, apart double")


def _parted(rows: DataFrame) -> DataFrame:
    """rows, one for each own node of a signature, with the signature's number of parts and the node's."""
    parts = rows.groupBy("sig").agg(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)).cast("int").alias("parts"))
    return rows.join(parts.hint("merge"), "sig").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))


def _nearest(large: DataFrame, nodes: DataFrame, turn: int, work: Scratch) -> DataFrame:
    """Pairs (x, y): each node outside its centre's component with its nearest in one of its signatures, the largest in the
    first turn and any in later ones."""
    outside = large.filter("label <> c_label")
    rank = F.struct(F.xxhash64("sig", F.lit(turn)), "sig")
    if turn == 1:
        outside, rank = outside.join(large.groupBy("sig").agg(F.count("*").alias("all_nodes")).hint("merge"), "sig"), F.struct("all_nodes", "sig")
    own = outside.groupBy("node").agg(F.max_by(F.struct("sig", "n", "label"), rank).alias("own")).select("node", "own.*")
    own = work.written(_parted(own), f"join-own{turn}")
    found = _blockwise(own, large.select("sig", "node", "n", "label"), nodes, True)
    found = found.groupBy("x").agg(F.min_by("y", F.struct("apart", "y")).alias("y"))
    return found.select(*_ordered("x", "y"))


def _small_pairs(mixed: DataFrame, few: DataFrame) -> DataFrame:
    """Pairs (x, y), some more than once: of each signature in few the nodes outside its centre's component, with all nodes
    of other components. There are SMALL of them for a signature at most."""
    rows = mixed.join(few.select("sig").hint("merge"), "sig")
    outside = rows.filter("label <> c_label").select("sig", F.col("node").alias("other"), F.col("label").alias("other_label"), F.col("n").alias("other_n"))
    pairs = rows.drop("c_label").join(outside.hint("merge"), "sig").filter("label <> other_label").filter(SIZES_ALLOW.format("n", "other_n"))
    return pairs.select(*_ordered("node", "other"))


def _texts(texts: DataFrame, need: DataFrame, label: str, work: Scratch) -> DataFrame:
    """Those of the rows (doc_id, mark, text) that need's (rep, mark) name, and a few others that a bitmap of bounded size
    lets through. Nothing is shuffled."""
    bitmap = work.written(key_bitmap(need.select(F.xxhash64("rep", "mark").alias("h")), "h"), f"{label}-bitmap")
    return keep_possible(texts.withColumn("h", F.xxhash64("doc_id", "mark")), "h", bitmap).drop("h")


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, label: str, work: Scratch) -> DataFrame:
    """Those of the pairs that link, as (a, b). Only texts that a pair needs are shuffled.

    A centre's pairs are dealt to parts of about STAR, each with its own copy of the centre's text, so no task has
    unboundedly many; tasks stream, and hold one set.
    """
    pairs = work.written(pairs, f"{label}-pairs")
    if pairs.isEmpty():
        return pairs.toDF("a", "b")
    need = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
    need = work.written(nodes.select("node", "rep", "mark").join(need.hint("merge"), "node", "left_semi"), f"{label}-need")
    found = _texts(texts, need, label, work).withColumnRenamed("doc_id", "rep").join(need.hint("merge"), ["rep", "mark"])
    found = work.written(found.select("node", "text").dropDuplicates(["node"]), f"{label}-texts")
    parts = pairs.groupBy("x").agg(F.ceil(F.count("*") / F.lit(STAR)).cast("int").alias("parts"))
    centers = parts.join(found.withColumnRenamed("node", "x").hint("merge"), "x")
    centers = centers.select(F.col("x").alias("a"), F.explode(F.expr("sequence(0, parts - 1)")).alias("part"), F.lit(None).cast("long").alias("b"), "text")
    members = pairs.join(parts.hint("merge"), "x").withColumn("part", F.pmod(F.xxhash64("y"), F.col("parts")).cast("int"))
    members = members.join(found.withColumnRenamed("node", "y").hint("merge"), "y")
    members = members.select(F.col("x").alias("a"), "part", F.col("y").alias("b"), "text")
    rows = centers.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return work.written(rows.mapInArrow(_compare, "a long, b long"), f"{label}-links")


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("x"), F.greatest(a, b).alias("y")]


def _placed(nodes: DataFrame, links: DataFrame, work: Scratch) -> DataFrame:
    """(node, n, label): each node's size and component by the links so far."""
    label = connected_components(links).select(F.col("id").alias("node"), "label")
    placed = nodes.select("node", "n").join(label.hint("merge"), "node", "left")
    return work.written(placed.select("node", "n", F.coalesce("label", "node").alias("label")), "join-places")


def _joined(placed: DataFrame, links: DataFrame, work: Scratch) -> DataFrame:
    """placed with components joined by further links: only these components are looked at. Nothing is done without links."""
    if links.isEmpty():
        return placed
    for side in ("a", "b"):
        links = links.join(placed.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")).hint("merge"), side)
    joined = connected_components(links.select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))).select(F.col("id").alias("label"), F.col("label").alias("to"))
    placed = placed.join(joined.hint("merge"), "label", "left")
    return work.written(placed.select("node", "n", F.coalesce("to", "label").alias("label")), "join-places")


def _mixed(members: DataFrame, placed: DataFrame, turn: int, work: Scratch) -> DataFrame:
    """(sig, node, n, label, c_label) of signatures held in several components; c_label is that of one of its nodes, another
    one each turn. Signatures of one component need no further look, since components only grow."""
    lab = members.select("sig", "node").join(placed.hint("merge"), "node")
    c = F.min_by("label", F.xxhash64("node", F.lit(turn)))
    several = lab.groupBy("sig").agg(F.min("label").alias("low"), F.max("label").alias("high"), c.alias("c_label")).filter("low <> high")
    return work.written(lab.join(several.select("sig", "c_label").hint("merge"), "sig"), f"join-mixed{turn}")


def _completed(members: DataFrame, placed: DataFrame, nodes: DataFrame, tried: DataFrame, texts: DataFrame, work: Scratch) -> DataFrame:
    """placed with components joined by all links that the pairs tried so far leave out. It ends where no signature is left."""
    mixed = _mixed(members, placed, 0, work)
    if mixed.isEmpty():
        return placed
    sizes = mixed.groupBy("sig").agg((F.count_if(F.col("label") != F.col("c_label")) * F.count("*")).alias("pairs"))
    sizes = work.written(sizes, "join-sizes")
    large = work.written(mixed.join(sizes.filter(F.col("pairs") > SMALL).select("sig").hint("merge"), "sig"), "join-large")
    pairs = _small_pairs(mixed, sizes.filter(F.col("pairs") <= SMALL))
    if not large.isEmpty():
        pairs = pairs.unionByName(_nearest(large, nodes, 1, work))
    for turn in range(1, NEAREST + 1):
        new = work.written(pairs.distinct().join(tried.hint("merge"), ["x", "y"], "left_anti"), f"join-new{turn}")
        if not new.isEmpty():
            tried = tried.unionByName(new)
            placed = _joined(placed, _verified(_possible(new, nodes), nodes, texts, f"join-turn{turn}", work), work)
        if large.isEmpty():
            return placed
        large = _mixed(large, placed, turn, work)
        if large.isEmpty():
            return placed
        if turn < NEAREST:
            pairs = _nearest(large, nodes, turn + 1, work)
    rest = _blockwise(_parted(large.filter("label <> c_label")), large, nodes, False)
    rest = work.written(rest.select(*_ordered("x", "y")).distinct(), "join-screened")
    rest = rest.join(tried.hint("merge"), ["x", "y"], "left_anti")
    return _joined(placed, _verified(_possible(rest, nodes), nodes, texts, "join-rest", work), work)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, n_shingles, component_id (the smallest id that it reaches by links), stays (whether it is the
    document that stands for its component).

    **Sets.** A document's set is its distinct word 5-grams, hashed to 64 bits. Documents of one set are one node; copies
    never meet each other.

    **Candidates.** For linked sets of s <= t shingles, 3t <= 4s, and at most (s + t) / 7 <= s / 3 shingles are in one
    of them alone. Each such shingle flips one bit of a parity sketch, so sketches differ in at most s / 3 bits. Size
    bands double; sets meet in the band of the larger, so a set also enters the next band if a partner there is
    possible. A band cuts its sketch into blocks; of the first n // 3 + 1 blocks in which a set has shingles at least one
    is untouched, thus equal in both (pigeonhole): these are its signatures. A shingle common in the corpus makes large
    groups of unrelated sets, so blocks are first filled with the other shingles alone; a set for which that leaves
    too few blocks signs with all shingles as well, and if those hash to too few blocks, with shingles one by one. Two
    sets of which one has enough blocks share one of its signatures, whatever was held to be common.

    **Links.** Nodes with an equal signature are a star around the first of them; a signature held by many is dealt to
    several tasks, whose stars share nodes. Each node is first compared with the centre that it shares most signatures
    with. Of signatures still held in several components, those with few pairs give them all; in the others each node
    outside its centre's component is compared with its nearest partner by sketch, and at last the candidates that are
    left are all compared: of each signature, the nodes outside its centre's component with the nodes of other
    components, in blocks. No link between components is lost, and links inside one need no test. Sizes, then the Hamming
    distance of dense sketches, go before the comparison of texts.

    Null and empty texts have empty sets, and stand alone. Rows that repeat id and text are one document, and stay or go
    together; rows that repeat an id with other texts are documents of their own. A null id is not linked, and stays. Texts
    of any length are read whole. An empty table gives an empty result; other columns are not looked at. Two different sets
    get one node with a chance of 2**-64 for each pair.
    """
    return _found(docs, id_col, text_col).select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", "stays")


def _found(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship_package(docs.sparkSession)
    work = Scratch(docs.sparkSession)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    described = work.written(base.mapInArrow(_describe, DESCRIBED), "join-sets")
    common = described.filter("common IS NOT NULL").groupBy("node").agg(F.sum("common").alias("times"))
    common = common.orderBy(F.desc("times"), "node").limit(COMMON_SENT).select("node").toArrow()["node"]
    common = np.sort(common.to_numpy().astype(np.int64).view(np.uint64))
    rows = described.filter("common IS NULL").select("doc_id", "mark", "n", "node")
    rows = work.written(rows, "join-rows", keep=True)
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))
    nodes = described.filter("common IS NULL AND node IS NOT NULL").groupBy("node").agg(
        F.min(named).alias("first"), F.max("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")
    )
    nodes = nodes.filter("first IS NOT NULL").select("node", F.col("first.doc_id").alias("rep"), F.col("first.mark").alias("mark"), "n", "sketch")
    nodes = work.written(nodes, "join-nodes")

    signed = base.filter("doc_id IS NOT NULL").select("text").mapInArrow(_signed(common), "sig long, node long")
    grouped = signed.repartition("sig").sortWithinPartitions("sig", "node").mapInArrow(_stars, "sig long, center long, member long")
    grouped = work.written(grouped, "join-stars")
    members = grouped.select("sig", F.col("member").alias("node")).unionByName(grouped.select("sig", F.col("center").alias("node")))
    members = work.written(members.distinct(), "join-members")
    wanted = nodes.select("node", "rep", "mark").join(members.select("node").distinct().hint("merge"), "node", "left_semi")
    texts = work.written(_texts(base, wanted, "join-wanted", work), "join-wanted-texts")

    pairs = grouped.groupBy("center", "member").agg(F.count("*").alias("shared"))
    best = pairs.groupBy("member").agg(F.max_by("center", F.struct("shared", "center")).alias("center"))
    tried = work.written(best.select(*_ordered("center", "member")).distinct(), "join-first")
    links = _verified(_possible(tried, nodes), nodes, texts, "join-first", work)
    placed = _placed(nodes, links, work)

    placed = _completed(members, placed, nodes, tried, texts, work)

    out = rows.join(placed.select("node", "label").hint("merge"), "node", "left")
    out = work.written(out, "join-out", keep=True)
    least = out.filter("label IS NOT NULL AND doc_id IS NOT NULL").groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    least = work.written(least, "join-least", keep=True)
    work.clear()
    out = out.join(least.hint("merge"), "label", "left")
    alone = F.col("label").isNull() | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id"))
    stays = alone | (F.struct("doc_id", "mark") == F.col("first"))
    return out.select("doc_id", "mark", F.col("n").alias("n_shingles"), component.alias("component_id"), stays.alias("stays"))


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that another document of their component stands for, all columns."""
    gone = _found(docs, id_col, text_col).filter("NOT stays").select(F.col("doc_id").alias("id"), "mark")
    return without_keys(docs, [F.col(f"`{id_col}`").cast("long"), F.xxhash64(F.col(f"`{text_col}`"))], gone)


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).drop("stays")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id WHERE l.b > r.root)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM documents d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
