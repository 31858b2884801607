"""Edit-aware token counts: a segment tree over each document's pre-tokens, of which edits touch a few leaves."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.text import or_empty, small_slices
from attestra.shipping import ship_package

#: Rank file of the byte-level BPE; a parameter of every function here. Each Python worker reads it.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of a leaf when a tree is built; a leaf of over four times as many makes the tree be built anew.
LEAF = 64
#: Characters before an edit that a pre-token's end can depend on: the pattern looks two characters past an end at most.
REACH = 2
CACHE = 300_000


class PreTokens(dict):
    """pre-token -> its number of tokens, remembered for up to CACHE pre-tokens."""

    def __init__(self, rank_file: str = RANKS):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) < CACHE:
            self[piece] = n
        return n


class CountTree:
    """Sums of characters, pre-tokens and tokens over the leaves of one text, in three arrays of a binary tree each.

    Node 1 is the root, node i has the children 2i and 2i + 1, leaves are the last half. Leaves begin and end where
    pre-tokens do.
    """

    def __init__(self, text: str, tokens: PreTokens, leaves: np.ndarray | None = None):
        """leaves: sums of characters, pre-tokens and tokens of each leaf, as `leaves` gave them for this text; nothing is
        encoded then."""
        self.tokens, self.text = tokens, text
        self.encoded = 0
        if leaves is None:
            self.build()
        else:
            self._grow(leaves)

    @property
    def leaves(self) -> np.ndarray:
        return self.sums[:, self.size : self.size + self.used]

    @property
    def count(self) -> int:
        return int(self.sums[2, 1])

    @property
    def pieces(self) -> int:
        return int(self.sums[1, 1])

    def _measure(self, pieces: list[str]) -> np.ndarray:
        """Characters, 1, and tokens of each pre-token."""
        self.encoded += len(pieces)
        n = len(pieces)
        out = np.ones((3, n), dtype=np.int64)
        out[0] = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        out[2] = np.fromiter(map(self.tokens.__getitem__, pieces), dtype=np.int64, count=n)
        return out

    def build(self) -> None:
        each = self._measure(self.tokens.pattern.findall(self.text))
        starts = np.arange(0, each.shape[1], LEAF)
        self._grow(np.add.reduceat(each, starts, axis=1) if len(starts) else np.zeros((3, 1), dtype=np.int64))

    def _grow(self, leaves: np.ndarray) -> None:
        self.used = leaves.shape[1]
        self.size = 1 << (self.used - 1).bit_length()
        self.sums = np.zeros((3, 2 * self.size), dtype=np.int64)
        self.sums[:, self.size : self.size + self.used] = leaves
        low = self.size
        while low > 1:
            self.sums[:, low // 2 : low] = self.sums[:, low : 2 * low].reshape(3, -1, 2).sum(axis=2)
            low //= 2

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds the character `at`, and where it starts; the last used leaf, if `at` is the text's end."""
        i, start = 1, 0
        while i < self.size:
            left = int(self.sums[0, 2 * i])
            i = 2 * i
            if at >= start + left and int(self.sums[0, i + 1]):
                start, i = start + left, i + 1
        return i - self.size, start

    def edit(self, at: int, cut: int, paste: str) -> None:
        """Replaces `cut` characters from `at` by `paste`; places past the end are the end.

        Pre-tokens are found by one scan from left to right that looks REACH characters ahead at most, so those that end
        REACH before the edit stay. The scan starts anew at the leaf with that character, and ends at the first leaf
        boundary behind the edit at which a pre-token of the new text ends: from there on both texts, and both scans, are
        the same. Only the leaves in between get new sums, and then their ancestors.
        """
        at = max(0, min(at, len(self.text)))
        cut = max(0, min(cut, len(self.text) - at))
        shift, stop = len(paste) - cut, at + cut
        first, start = self.find(max(0, at - REACH))
        self.text = self.text[:at] + paste + self.text[stop:]
        last, end = first, start + int(self.sums[0, self.size + first])
        pieces, here = [], start
        for m in self.tokens.pattern.finditer(self.text, start):
            pieces.append(m.group())
            here = m.end()
            while end + shift < here and last + 1 < self.used or end < stop and last + 1 < self.used:
                last += 1
                end += int(self.sums[0, self.size + last])
            if end >= stop and end + shift == here and here >= at + len(paste):
                break
        else:
            last = self.used - 1
        each = self._measure(pieces)
        slots = last - first + 1
        if each.shape[1] > 4 * LEAF * slots:
            self.build()
            return
        cuts = np.linspace(0, each.shape[1], slots + 1).astype(int)
        for k in range(slots):
            self.sums[:, self.size + first + k] = each[:, cuts[k] : cuts[k + 1]].sum(axis=1)
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            self.sums[:, low : high + 1] = self.sums[:, 2 * low : 2 * high + 2].reshape(3, -1, 2).sum(axis=2)
            low, high = low // 2, high // 2


_TOKENS: dict[str, PreTokens] = {}


def pre_tokens(rank_file: str) -> PreTokens:
    if rank_file not in _TOKENS:
        _TOKENS[rank_file] = PreTokens(rank_file)
    return _TOKENS[rank_file]


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with an array `edits` of (at, cut, paste), in order of seq, from rows (id, seq, at, cut, paste)."""
    by_doc = edits.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("seq", "at", "cut", "paste"))).alias("edits"))
    by_doc = by_doc.withColumn("edits", F.transform("edits", lambda e: F.struct(e["at"].alias("at"), e["cut"].alias("cut"), e["paste"].alias("paste"))))
    return docs.join(by_doc.hint("merge"), id_col, "left")


#: A kept tree: its text's checksum, and the sums of its leaves; inner nodes follow from these.
TREE = "struct<crc:bigint,chars:array<bigint>,pieces:array<bigint>,tokens:array<bigint>>"
SUMS = ["chars", "pieces", "tokens"]


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _kept_leaves(tree: pa.StructScalar, text: str) -> np.ndarray | None:
    """The leaves of a kept tree; None if there is none, or one of another text."""
    if not tree.is_valid or tree["crc"].as_py() != _crc(text):
        return None
    parts = [tree[name].values for name in SUMS]
    if any(x is None or x.null_count for x in parts) or len({len(x) for x in parts}) != 1 or not len(parts[0]):
        return None
    leaves = np.stack([x.to_numpy(zero_copy_only=False) for x in parts]).astype(np.int64)
    return leaves if leaves.min() >= 0 and leaves[0].sum() == len(text) else None


def edited_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", rank_file: str = RANKS, tree_col: str | None = None
) -> DataFrame:
    """(id, n_before, n_after, n_pieces, n_encoded, text) of each row; with tree_col also n_built and that column.

    n_before and n_after: tokens before and after its edits, which follow one another, each on the text that the last one
    left. n_pieces: pre-tokens in the end; n_encoded: those that edits made to be encoded again; text: the edited text.

    tree_col names the column of kept trees (type TREE). The result's tree is that of the edited text, so a table of
    results is the input of the next batch of edits, of which each row then costs its touched leaves alone. n_built counts
    the pre-tokens encoded to make a tree first: 0 if one was kept. The column may be missing from docs. A null tree, one
    with a null part, and one whose checksum or length is not the text's is made anew; trees of another rank file can't be
    told apart, so a table of trees belongs to one.

    A null text is empty; null edits, and an empty list, are none; a null place or cut is 0, a null paste is empty. A very
    long text is one row's work. Equal rows get equal results, an empty table an empty one. Columns other than those
    named here are left out; the id's name must not be one of the result's.
    """
    ship_package(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pre_tokens(rank_file)
        for batch in (part for whole in batches for part in small_slices(whole, 1)):
            columns: list[list] = [[] for _ in range(6)]
            grown: list[list] = [[] for _ in range(4)]
            for i, (text, edits) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
                text = text.as_py() or ""
                tree = CountTree(text, tokens, _kept_leaves(batch.column(3)[i], text) if tree_col else None)
                before, built, tree.encoded = tree.count, tree.encoded, 0
                for e in edits.as_py() or []:
                    tree.edit(e["at"] or 0, e["cut"] or 0, e["paste"] or "")
                for column, value in zip(columns, (before, tree.count, tree.pieces, tree.encoded, tree.text, built), strict=True):
                    column.append(value)
                if tree_col:
                    for column, value in zip(grown, (_crc(tree.text), *tree.leaves), strict=True):
                        column.append(value)
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.string())]
            names = [id_col, "n_before", "n_after", "n_pieces", "n_encoded", "text"]
            if tree_col:
                kept = [pa.array(grown[0], pa.int64()), *[pa.array(c, pa.list_(pa.int64())) for c in grown[1:]]]
                arrays += [pa.array(columns[5], pa.int64()), pa.StructArray.from_arrays(kept, names=["crc", *SUMS])]
                names += ["n_built", tree_col]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    columns = [F.col(f"`{c}`") for c in (id_col, text_col, edits_col)]
    schema = f"`{id_col}` {kind}, n_before long, n_after long, n_pieces long, n_encoded long, text string"
    if tree_col:
        columns.append((F.col(f"`{tree_col}`") if tree_col in docs.columns else F.lit(None)).cast(TREE).alias(tree_col))
        schema += f", n_built long, `{tree_col}` {TREE}"
    return docs.select(*columns).mapInArrow(count, schema)


def sample_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count: int = 4) -> DataFrame:
    """docs with `count` edits each, made from the row itself: at a place by hash, up to 40 characters are replaced by a
    stretch of the same text, of up to 30."""
    text, n = or_empty(F.col(text_col)), F.char_length(or_empty(F.col(text_col)))
    place = lambda *salt: F.pmod(F.xxhash64(id_col, *[F.lit(s) for s in salt]), (n + 1).cast("long")).cast("int")
    size = lambda most, *salt: F.pmod(F.xxhash64(id_col, *[F.lit(s) for s in salt]), F.lit(most + 1)).cast("int")
    one = lambda k: F.struct(
        place(k, 1).alias("at"), size(40, k, 2).alias("cut"), F.substring(text, place(k, 3) + 1, size(30, k, 4)).alias("paste")
    )
    return docs.withColumn("edits", F.array(*[one(k) for k in range(count)]))


def edited_counts_report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_before, n_after, n_pieces, n_encoded, text_sha256 of the edited text."""
    out = edited_counts(sample_edits(docs.select("doc_id", "text")))
    return out.select("doc_id", "n_before", "n_after", "n_pieces", "n_encoded", F.sha2("text", 256).alias("text_sha256"))
