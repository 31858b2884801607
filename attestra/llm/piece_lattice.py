"""SentencePiece encoding and decoding: N-best segmentation by a backward A* search over the piece lattice."""

from __future__ import annotations

import heapq
import math
import re
from array import array
from bisect import insort
from collections.abc import Callable, Iterator, Sequence
from itertools import chain, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.text import small_slices
from attestra.shipping import ship_package

#: Segmentations of a text, best first.
N_BEST = 4
#: The model's place; a parameter of every function here. The file is read by each Python worker.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Chunks after which a worker starts a new generation of remembered segmentations (it keeps two), and the longest chunk kept.
CACHE, KEPT_CHARS = 100_000, 64
#: Rows that are decoded at once.
SLICE = 125
#: Characters of a chunk from which numbers of its places are packed.
LONG = 4_096
#: Zipf-Mandelbrot offset: a piece of rank r has probability in proportion to 1 / (r + OFFSET).
OFFSET = 10

SPACE_MARK = "▁"
Arc = tuple[int, float, tuple[int, ...]]  # where it ends, its score, its piece ids


Best = tuple[tuple[int, ...], float, float]  # ids, score, distance to the second best
#: A stretch of the best segmentation that another one has otherwise: its first place, its number of ids, and the ids instead.
Stretch = tuple[int, int, tuple[int, ...]]


class PieceModel:
    """Pieces of a SentencePiece model as a lattice vocabulary.

    The model's merge ranks are turned to log-probabilities by Zipf's law, which makes its pieces a unigram model. Spaces
    are kept as spaces here (the file's space marks are translated), so a space mark of a text is a character like any
    other. A character without a piece is its UTF-8 bytes' pieces in one arc, so every text has a segmentation.
    """

    def __init__(self, model_file: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.numbers = list(range(size))
        plain = [i for i in self.numbers if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        total = math.log(sum(1 / (r + OFFSET) for r in range(len(plain))))
        self.ids = {self.pieces[i].replace(SPACE_MARK, " "): i for i in plain}
        self.scores = {p: -math.log(r + OFFSET) - total for r, p in enumerate(self.ids)}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.of_byte = {i: b for b, i in enumerate(self.bytes)}
        self.raw = [bytes([self.of_byte[i]]) if i in self.of_byte else p.replace(SPACE_MARK, " ").encode("utf-8") for i, p in enumerate(self.pieces)]
        self.byte_score = -math.log(len(plain) + OFFSET) - total - 1
        #: A tree of the pieces' characters: character -> [score or None, tree of what follows or None].
        self.tree = self._tree(lambda piece: piece)
        #: The same of the pieces read from their ends.
        self.back = self._tree(lambda piece: piece[::-1])
        self._number()
        #: chunk -> its best segmentation, of late and of the generation before; chunk -> its n best.
        self.known: dict[str, Best] = {}
        self.older: dict[str, Best] = {}
        self.ranked: dict[tuple[str, int], list] = {}
        # A line feed and a space after another character are never inside a piece: all segmentations part there.
        inside = [p for p in self.ids if "\n" in p or " " in p.lstrip(" ")]
        self.chunks = re.compile(r"\n| *[^ \n]+| +").findall if not inside else (lambda text: [text])

    def _tree(self, read: Callable[[str], str]) -> dict[str, list]:
        tree: dict[str, list] = {}
        for piece, score in self.scores.items():
            level, way = tree, read(piece)
            for c in way[:-1]:
                node = level.setdefault(c, [None, None])
                if node[1] is None:
                    node[1] = {}
                level = node[1]
            level.setdefault(way[-1], [None, None])[0] = score
        return tree

    def _number(self) -> None:
        """The pieces' tree as arrays, for many chunks at once: column of a character, (node, column) -> node, and each
        node's score and piece id."""
        letters = sorted({c for p in self.ids for c in p})
        self.column = np.full(0x110000, -1, dtype=np.int32)
        self.column[[ord(c) for c in letters]] = np.arange(len(letters))
        self.wide = len(letters)
        nodes, steps = {"": 0}, {}
        for piece in self.ids:
            for k in range(1, len(piece) + 1):
                if piece[:k] not in nodes:
                    nodes[piece[:k]] = len(nodes)
                    steps[nodes[piece[: k - 1]] * self.wide + int(self.column[ord(piece[k - 1])])] = nodes[piece[:k]]
        self.node_score = np.array([self.scores.get(p, math.nan) for p in nodes])
        self.node_id = np.array([self.ids.get(p, -1) for p in nodes], dtype=np.int32)
        self.step_key = np.array(sorted(steps), dtype=np.int64)
        self.step_to = np.array([steps[k] for k in sorted(steps)], dtype=np.int32)

    def arcs(self, chunk: str) -> list[list[Arc]]:
        """For each place, the arcs that start there."""
        n, out = len(chunk), []
        for i in range(n):
            here, level, j = [], self.tree, i
            while level is not None and j < n and (node := level.get(chunk[j])) is not None:
                j += 1
                score, level = node
                if score is not None:
                    here.append((j, score, (self.ids[chunk[i:j]],)))
            if not here or here[0][0] != i + 1:
                raw = chunk[i].encode("utf-8", "surrogatepass")
                here.append((i + 1, self.byte_score * len(raw), tuple(self.bytes[b] for b in raw)))
            out.append(here)
        return out

    def into(self, chunk: str, at: int) -> list[tuple[int, float]]:
        """(start, score) of each arc that ends at a place, shortest first."""
        out, level, i = [], self.back, at
        while level is not None and i and (node := level.get(chunk[i - 1])) is not None:
            i -= 1
            score, level = node
            if score is not None:
                out.append((i, score))
        if not out or out[0][0] != at - 1:
            out.insert(0, (at - 1, self.byte_score * len(chunk[at - 1].encode("utf-8", "surrogatepass"))))
        return out

    def forward(self, chunk: str) -> tuple[Sequence[float], Sequence[float], Sequence[int]]:
        """Viterbi: for each place the best and the second best score of a way there from the start, and the start of the
        best one's last arc.

        A place's second best either ends by another arc than its best, or prolongs the second best of the place where
        that arc starts.
        """
        n, tree = len(chunk), self.tree
        none = -math.inf
        best, second, last = [none] * (n + 1), [none] * (n + 1), [0] * (n + 1)
        if n > LONG:  # packed numbers: 20 bytes a place
            best, second, last = array("d", best), array("d", second), array("i", last)
        best[0] = 0.0
        for i in range(n):
            at, at2, level, j = best[i], second[i], tree, i
            node = level.get(chunk[i])
            if node is None or node[0] is None:  # no piece of its own: its bytes
                by = self.byte_score * len(chunk[i].encode("utf-8", "surrogatepass"))
                if at + by > best[i + 1]:
                    second[i + 1] = max(best[i + 1], at2 + by)
                    best[i + 1], last[i + 1] = at + by, i
                elif at + by > second[i + 1]:
                    second[i + 1] = at + by
            while node is not None:
                j += 1
                score, level = node
                if score is not None:
                    whole, top = at + score, best[j]
                    if whole > top:
                        other = at2 + score
                        second[j] = top if top > other else other
                        best[j], last[j] = whole, i
                    elif whole > second[j]:
                        second[j] = whole
                if level is None or j == n:
                    break
                node = level.get(chunk[j])
        return best, second, last

    def piece_ids(self, chunk: str, places: Sequence[int]) -> tuple[int, ...]:
        """Ids of the pieces between places, which run from the chunk's end to its start."""
        ids: list[int] = []
        own = self.ids.get
        j = places[0]
        for i in islice(places, 1, None):
            piece = own(chunk[i:j])
            if piece is None:
                ids.extend(self.bytes[x] for x in reversed(chunk[i:j].encode("utf-8", "surrogatepass")))
            else:
                ids.append(piece)
            j = i
        ids.reverse()
        return tuple(ids)

    def segment(self, chunk: str) -> Best:
        """Ids of the best segmentation, its score, and how far below it the second best is (inf: there is none)."""
        best, second, last = self.forward(chunk)
        places = [len(chunk)]
        while places[-1]:
            places.append(last[places[-1]])
        return self.piece_ids(chunk, places), best[-1], best[-1] - second[-1]

    def segment_many(self, chunks: list[str]) -> list[Best]:
        """segment() of many short chunks, place by place over all of them: the same sums in the same order."""
        n, size = len(chunks), np.fromiter(map(len, chunks), dtype=np.int64, count=len(chunks))
        width = int(size.max())
        code = np.frombuffer("".join(c.ljust(width) for c in chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(n, width).T
        column = self.column[code]
        by_bytes = self.byte_score * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        best, second = np.full((width + 1, n), -np.inf), np.full((width + 1, n), -np.inf)
        last, node_of = np.zeros((width + 1, n), dtype=np.int16), np.full((width + 1, n), -1, dtype=np.int32)
        best[0] = 0.0

        def relax(rows: np.ndarray, start: int, end: int, score: np.ndarray, nodes: np.ndarray | int) -> None:
            whole, other = best[start].take(rows) + score, second[start].take(rows) + score
            top = best[end].take(rows)
            better = whole > top
            second[end][rows] = np.where(better, np.maximum(top, other), np.maximum(second[end].take(rows), whole))
            best[end][rows] = np.maximum(whole, top)
            changed = rows[better]
            last[end][changed] = start
            node_of[end][changed] = nodes[better] if isinstance(nodes, np.ndarray) else nodes

        for i in range(width):
            rows, end = np.flatnonzero(size > i), i
            at = np.zeros(len(rows), dtype=np.int32)
            while len(rows):
                letter = column[end].take(rows)
                key = at.astype(np.int64) * self.wide + letter
                found = np.minimum(np.searchsorted(self.step_key, key), len(self.step_key) - 1)
                there = (self.step_key.take(found) == key) & (letter >= 0)
                if end == i:  # a character without a piece of its own: its bytes
                    lacks = rows[~there | np.isnan(self.node_score[self.step_to[found]])]
                    if len(lacks):
                        relax(lacks, i, i + 1, by_bytes[i, lacks], -1)
                rows, at = rows[there], self.step_to[found[there]]
                end += 1
                score = self.node_score[at]
                piece = ~np.isnan(score)
                if piece.any():
                    relax(rows[piece], i, end, score[piece], at[piece])
                more = size[rows] > end
                rows, at = rows[more], at[more]
        place, steps, plain = size.copy(), [], np.ones(n, dtype=bool)
        rows = np.arange(n)
        while len(rows):
            node = node_of[place[rows], rows]
            plain[rows[node < 0]] = False
            ids = np.full(n, -1, dtype=np.int32)
            ids[rows] = self.node_id[node]
            steps.append(ids)
            place[rows] = last[place[rows], rows]
            rows = rows[place[rows] > 0]
        table = np.stack(steps[::-1], axis=1)
        used = (table >= 0).sum(axis=1)
        # remembered ids are the model's own numbers, not a copy for each place
        flat, ends = list(map(self.numbers.__getitem__, table[table >= 0].tolist())), np.cumsum(used).tolist()
        top, gap = best[size, np.arange(n)].tolist(), (best[size, np.arange(n)] - second[size, np.arange(n)]).tolist()
        out, begin = [], 0
        for k, end in enumerate(ends):
            if plain[k]:
                out.append((tuple(flat[begin:end]), top[k], gap[k]))
            else:
                places = [len(chunks[k])]
                while places[-1]:
                    places.append(int(last[places[-1], k]))
                out.append((self.piece_ids(chunks[k], places), top[k], gap[k]))
            begin = end
        return out

    def learn(self, texts: list[list[str]], remembered: int = CACHE) -> None:
        """Makes the best segmentations of all chunks of some texts known. Long chunks are to be forgotten by the caller."""
        if len(self.known) > remembered:
            self.known, self.older, self.ranked = {}, self.known, {}
        new = set().union(*texts) - self.known.keys()
        again = new & self.older.keys()
        self.known.update((c, self.older[c]) for c in again)
        new = sorted(new - again, key=len)
        short = [c for c in new if len(c) <= KEPT_CHARS]
        for i in range(0, len(short), 8_192):
            self.known.update(zip(short[i : i + 8_192], self.segment_many(short[i : i + 8_192]), strict=True))
        self.long = new[len(short) :]
        self.known.update((c, self.segment(c)) for c in self.long)

    def forget_long(self) -> None:
        for c in self.long:
            del self.known[c]

    def n_best(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations with their scores, best first. Of equal ones the one that leaves the best way nearer to
        the chunk's end comes first.

        A* from the end of the chunk: a state is a way from some place to the end, and the forward Viterbi score of that
        place, which is exact, tells the best whole way through it. So a state that leaves the queue is followed along
        the Viterbi arcs to the start, which gives the next best segmentation; each other arc into a place passed is a
        new state. Each state stands for a whole way of its own, so a queue of as many states as ways are still wanted
        is enough. A state is named by the way that it leaves, the places that it shares with it, and the start of its
        first other arc: memory is the n ways' places and the Viterbi arrays, whatever the number of equal scores.
        """
        fore, _, last = self.forward(chunk)
        queue: list[tuple[float, int, int, int, int, float]] = [(-fore[-1], 0, -1, 0, len(chunk), 0.0)]
        ways: list[array] = []
        out, made = [], 1
        while queue and len(out) < n:
            cost, _, parent, shared, at, done = queue.pop(0)
            places = ways[parent][:shared] if parent >= 0 else array("i")
            places.append(at)
            room = n - len(out) - 1
            del queue[room:]
            while at:
                step, own = last[at], 0.0
                for i, s in self.into(chunk, at):
                    if i == step:
                        own = s
                    elif room:
                        whole = -(fore[i] + s + done)
                        if len(queue) < room or whole < queue[-1][0]:
                            insort(queue, (whole, made, len(ways), len(places), i, s + done))
                            made += 1
                            del queue[room:]
                done += own
                at = step
                places.append(at)
            ways.append(places)
            out.append((-cost, self.piece_ids(chunk, places)))
        return out

    def ways(self, parts: list[str], n: int = N_BEST) -> tuple[list[Best], list[tuple[float, dict[int, tuple[int, ...]]]]]:
        """The best segmentation of each part of a whole text, and the n best of the whole: what each loses against the
        best, and the parts in which it differs. The parts are the text's chunks, which learn() has been given.

        Parts that pieces cannot cross are segmented apart. An n-best whole differs from the best in the n - 1 parts alone
        whose second best is nearest (each other part has n better ones before it), so only these are searched further,
        and their n-best lists are combined.
        """
        found = list(map(self.known.__getitem__, parts))
        gaps = np.fromiter(map(itemgetter(2), found), dtype=np.float64, count=len(found))
        near = np.argsort(gaps, kind="stable")[: n - 1] if len(gaps) < 64 else (k := np.argpartition(gaps, n - 1)[:n])[np.lexsort((k, gaps[k]))][: n - 1]
        ways: list[tuple[float, dict[int, tuple[int, ...]]]] = [(0.0, {})]
        for i in near.tolist():
            if gaps[i] == math.inf:
                break
            options = self.ranked.get((parts[i], n))
            if options is None:
                options = self.n_best(parts[i], n)
                if len(parts[i]) <= KEPT_CHARS and len(self.ranked) < CACHE:
                    self.ranked[parts[i], n] = options
            ways = heapq.nsmallest(
                n,
                ((loss + options[0][0] - s, chosen if k == 0 else {**chosen, i: ids}) for loss, chosen in ways for k, (s, ids) in enumerate(options)),
                key=itemgetter(0),
            )
        return found, ways

    def encode(self, text: str, n: int = N_BEST) -> list[tuple[float, list[int]]]:
        """The n best segmentations of a whole text with their scores, best first."""
        parts = self.chunks(" " + text)
        self.learn([parts])
        found, ways = self.ways(parts, n)
        self.forget_long()
        total = sum(f[1] for f in found)
        return [(total - loss, [x for i, f in enumerate(found) for x in chosen.get(i, f[0])]) for loss, chosen in ways]

    def decode(self, ids: list[int]) -> str:
        """The text whose segmentation ids are: the exact inverse of encode()."""
        raw = bytearray()
        for i in ids:
            b = self.of_byte.get(i)
            if b is None:
                raw += self.pieces[i].replace(SPACE_MARK, " ").encode("utf-8")
            else:
                raw.append(b)
        return raw.decode("utf-8", "surrogatepass").removeprefix(" ")

    def gives(self, ids: list[int], text: str) -> bool:
        """Whether ids decode to the text."""
        return b"".join(map(self.raw.__getitem__, ids)) == (" " + text).encode("utf-8", "surrogatepass")

    def same(self, ids: list[int], other: list[Stretch]) -> bool:
        """Whether the stretches stand for the same bytes as the ids that they replace, so that both decode alike."""
        raw = self.raw.__getitem__
        return all(b"".join(map(raw, ids[start : start + length])) == b"".join(map(raw, instead)) for start, length, instead in other)


_MODELS: dict[str, PieceModel] = {}


def piece_model(model_file: str) -> PieceModel:
    """The worker's model of that file; read once."""
    if model_file not in _MODELS:
        _MODELS[model_file] = PieceModel(model_file)
    return _MODELS[model_file]


_OTHERS = "array<array<struct<start:int,length:int,ids:array<int>>>>"
_OTHERS_ARROW = pa.list_(pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ids", pa.list_(pa.int32()))])))


def stretches(found: list[Best], begins: np.ndarray, chosen: dict[int, tuple[int, ...]]) -> list[Stretch]:
    """Where a segmentation differs from the best one, in order; equal ids at both ends of a part are left out. begins: the
    place of each part's first id."""
    out = []
    for i in sorted(chosen):
        old, new, a, b = found[i][0], chosen[i], 0, 0
        least = min(len(old), len(new))
        while a < least and old[a] == new[a]:
            a += 1
        while b < least - a and old[-1 - b] == new[-1 - b]:
            b += 1
        out.append((int(begins[i]) + a, len(old) - a - b, new[a : len(new) - b]))
    return out


def restored(ids: list[int], other: list[Stretch]) -> list[int]:
    """The ids of a segmentation from those of the best one and its stretches."""
    out, done = [], 0
    for start, length, instead in other:
        out += ids[done:start]
        out += instead
        done = start + length
    return out + list(ids[done:])


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N_BEST, model_file: str = MODEL, verify: bool = False, remembered: int = CACHE) -> DataFrame:
    """(id, ids, scores, n_pieces, others) of each row: the best segmentation's piece ids, the n best's scores and numbers of
    pieces, and for the second to the n-th the stretches in which they differ from the best; all_segmentations() and
    decode_segmentations() restore them. verify adds decodes: whether each, restored so, decodes to the text.

    Whole texts; a null text is an empty one, whose segmentation is that of the leading space alone. Equal rows get
    equal results. A row's work and memory grow with its text's length, whatever the number of equal scores; a worker also
    keeps two generations of about so many remembered chunks, and takes slices of rows in proportion: fewer cost less memory
    and more time, and results are the same. Scores are log-probabilities by rank (see PieceModel), since a
    byte-pair model's own scores are merge ranks, whose sums say nothing of a whole segmentation.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        for whole in batches:
            for batch in small_slices(whole, 1, max(1, remembered // 200), 40 * remembered):
                ids, scores, sizes, others, decodes = [], [], [], [], []
                texts = [text or "" for text in batch.column(1).to_pylist()]
                chunks = [model.chunks(" " + text) for text in texts]
                model.learn(chunks, remembered)
                for text, parts in zip(texts, chunks, strict=True):
                    found, ways = model.ways(parts, n)
                    sure = list(map(itemgetter(0), found))
                    ends = np.cumsum(np.fromiter(map(len, sure), dtype=np.int64, count=len(sure)))
                    best = list(chain.from_iterable(sure))
                    total = sum(map(itemgetter(1), found))
                    ids.append(pa.array(best, pa.int32()))
                    scores.append([total - loss for loss, _ in ways])
                    sizes.append([len(best) + sum(len(x) - len(found[i][0]) for i, x in chosen.items()) for _, chosen in ways])
                    begins = np.concatenate([[0], ends[:-1]])
                    rest = [stretches(found, begins, chosen) for _, chosen in ways[1:]]
                    others.append([[{"start": a, "length": k, "ids": x} for a, k, x in other] for other in rest])
                    if verify:
                        whole_text = model.gives(best, text)
                        decodes.append([whole_text, *[model.gives(restored(best, other), text) if not (whole_text and model.same(best, other)) else True for other in rest]])
                model.forget_long()
                offsets = [0]
                for x in ids:
                    offsets.append(offsets[-1] + len(x))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(ids)),
                        pa.array(scores, pa.list_(pa.float64())),
                        pa.array(sizes, pa.list_(pa.int32())),
                        pa.array(others, _OTHERS_ARROW),
                        *([pa.array(decodes, pa.list_(pa.bool_()))] if verify else []),
                    ],
                    names=[id_col, "ids", "scores", "n_pieces", "others", *(["decodes"] if verify else [])],
                )
        model.known, model.older, model.ranked = {}, {}, {}  # the worker may go on to other work

    ship_package(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(
        encode,
        f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, ids array<int>, scores array<double>, n_pieces array<int>, others {_OTHERS}" + (", decodes array<boolean>" if verify else ""),
    )


def decode_pieces(encoded: DataFrame, id_col: str = "doc_id", model_file: str = MODEL) -> DataFrame:
    """(id, text) from (id, ids). Null ids are a null text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                texts = [model.decode(x.as_py()) if x.is_valid else None for x in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    ship_package(encoded.sparkSession)
    return encoded.select(id_col, "ids").mapInArrow(decode, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, text string")


def _of_all(encoded: DataFrame, id_col: str, name: str, kind: str, arrow: pa.DataType, make: Callable[[list[int]], object]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                out = []
                for ids, others in zip(batch.column(1), batch.column(2)):
                    ids = ids.as_py()
                    rest = [[(x["start"], x["length"], x["ids"]) for x in other] for other in others.as_py() or []]
                    out.append(None if ids is None else [make(ids), *[make(restored(ids, other)) for other in rest]])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow)], names=[id_col, name])

    ship_package(encoded.sparkSession)
    return encoded.select(id_col, "ids", "others").mapInArrow(run, f"`{id_col}` {encoded.schema[id_col].dataType.simpleString()}, {name} {kind}")


def all_segmentations(encoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, segmentations): the piece ids of each of the n best, best first, from (id, ids, others)."""
    return _of_all(encoded, id_col, "segmentations", "array<array<int>>", pa.list_(pa.list_(pa.int32())), lambda ids: ids)


def decode_segmentations(encoded: DataFrame, id_col: str = "doc_id", model_file: str = MODEL) -> DataFrame:
    """(id, texts): the text of each of the n best, best first, from (id, ids, others)."""
    return _of_all(encoded, id_col, "texts", "array<string>", pa.list_(pa.string()), lambda ids: piece_model(model_file).decode(ids))


def piece_report(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, ids (best segmentation), scores and n_pieces of the N_BEST best, others (where the
    second to the last differ from the best), decodes (whether each decodes to the text)."""
    return encode_pieces(docs, verify=True).select("doc_id", "ids", F.transform("scores", lambda s: F.round(s, 6)).alias("scores"), "n_pieces", "others", "decodes")
