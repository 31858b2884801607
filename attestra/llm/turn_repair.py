"""Repair of conversation structure: the cheapest edits by a Viterbi search whose survivors share a backpointer tree."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestra.llm.text import SPACES
from attestra.shipping import ship_package

#: Costs of the edits, and of a truncated row that stays. Edits are named by their initials: Keep, Rerole, Delete, Insert.
RETAIN, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: What has been written so far: nothing, a system turn, a user turn last, an assistant turn last. (s?(ua)+)? ends in NONE or A.
NONE, S, U, A = range(4)
#: Unresolved edits at which survivors are first looked through for a shared ancestor.
LOOK = 16

ORDER = ["turn", "role", "text"]


class Edit:
    """A node of the backpointer tree: one edit, the edit before it, and how many edits or states rest on it."""

    __slots__ = ("before", "letter", "rests", "depth")

    def __init__(self, before: Edit | None, letter: str):
        self.before, self.letter, self.rests, self.depth = before, letter, 1, before.depth + 1 if before else 0
        if before:
            before.rests += 1


def release(edit: Edit | None) -> None:
    """One that rested on the edit is gone; edits that nothing rests on leave the tree."""
    while edit:
        edit.rests -= 1
        if edit.rests:
            return
        edit = edit.before


def comes_first(x: Edit, y: Edit) -> bool:
    """Whether the edits up to x are less in ASCII order than those up to y: both are followed to where they part."""
    a, b = [], []
    while x is not y:
        if x.depth >= y.depth:
            a.append(x.letter)
            x = x.before
        else:
            b.append(y.letter)
            y = y.before
    return a[::-1] < b[::-1]


class Repair:
    """The cheapest edits of one conversation, whose rows come one by one in order; ties go to the ASCII-least edits.

    Four states survive each row at most, one for what may have been written so far. Their edits share a tree; what all
    of them rest on is decided and is emitted with its row, so only undecided edits and their rows are held. A tie is
    settled by the undecided edits alone, which are compared in full. Two ways to the same state at the same cost never
    are the one a beginning of the other, since an insertion more costs more; so the lesser one stays the lesser whatever follows.
    The states NONE and S are given up once A is cheaper by more than what they can still save: 4 (a system turn that A has to
    delete) and 0.
    """

    def __init__(self, emit: Callable[[str, str, str], None]):
        self.emit, self.written, self.look = emit, NONE, LOOK
        self.rows: deque[tuple[str, str]] = deque()
        self.root = Edit(None, "")
        self.best: list[tuple[int, Edit] | None] = [(0, self.root), None, None, None]
        self._insert(self.best)

    @staticmethod
    def _offer(best: list, state: int, cost: int, before: Edit, letter: str) -> None:
        held = best[state]
        if held and held[0] < cost:
            return
        edit = Edit(before, letter)
        if held and held[0] == cost and not comes_first(edit, held[1]):
            release(edit)
            return
        best[state] = (cost, edit)
        if held:
            release(held[1])

    def _insert(self, best: list) -> None:
        """Inserted turns after what each state has; a third one in a row never pays."""
        for _ in range(2):
            for state in (NONE, S, A, U):
                if best[state]:
                    self._offer(best, A if state == U else U, best[state][0] + INSERT, best[state][1], "I")

    def add(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        new: list[tuple[int, Edit] | None] = [None] * 4
        initial, extra = role[:1], TRUNCATED if truncated else 0
        self.rows.append((role, text))
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, edit = held
            self._offer(new, state, cost + DELETE, edit, "D")
            if must_go:
                continue
            target = A if state == U else U
            if initial == ("a" if state == U else "u"):
                self._offer(new, target, cost + RETAIN + extra, edit, "K")
            else:
                self._offer(new, target, cost + REROLE + extra, edit, "R")
                if initial == "s" and state == NONE:
                    self._offer(new, S, cost + RETAIN + extra, edit, "K")
        self._insert(new)
        for held in self.best:
            if held:
                release(held[1])
        for state, lead in ((NONE, DELETE), (S, 0)):
            if new[state] and new[A] and new[state][0] > new[A][0] + lead:
                release(new[state][1])
                new[state] = None
        self.best = new
        if len(self.rows) >= self.look:
            self._decide(next(x[1] for x in new if x))
            self.look = max(LOOK, 2 * len(self.rows))

    def _decide(self, edit: Edit, last: bool = False) -> None:
        """Emits the edits that everything rests on; the last time, all of them."""
        path = []
        while edit is not self.root:
            path.append(edit)
            edit = edit.before
        while path and (last or self.root.rests == 1):
            self.root = path.pop()
            self.root.before = None
            self._write(self.root.letter)

    def _write(self, letter: str) -> None:
        role, text = ("", "") if letter == "I" else self.rows.popleft()
        if letter in "IR":
            role = "assistant" if self.written == U else "user"
        if letter != "D":
            self.written = S if role[:1] == "s" else U if role[:1] == "u" else A
        self.emit(letter, role, text)

    def finish(self) -> int:
        """Emits what is left and gives the cost."""
        cost, edit = min((x for x in (self.best[NONE], self.best[A]) if x), key=lambda x: x[0])
        if self.best[NONE] and self.best[A] and self.best[NONE][0] == self.best[A][0] and comes_first(self.best[A][1], self.best[NONE][1]):
            edit = self.best[A][1]
        self._decide(edit, last=True)
        return cost


class Conversation:
    """Counts of a conversation's rows, and the digest of its repair; rows come in order."""

    def __init__(self, conv_id: int | None, sink: Callable | None = None):
        self.conv_id, self.sink = conv_id, sink
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = self.role = None
        self.turns = self.illegal = 0
        self.audit, self.hash, self.empty = [], sha256(), True
        self.repair = Repair(self._emit)

    def _emit(self, letter: str, role: str, text: str) -> None:
        if self.sink:
            self.sink(self.conv_id, len(self.audit), letter, role, text)
        self.audit.append(letter)
        if letter != "D":
            self.hash.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            self.empty = False

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.last:
            self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
        if self.role is not None and self.role[:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role
        if fault:
            self.faults[fault] += 1
        self.repair.add(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def finish(self) -> tuple:
        cost = self.repair.finish()
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.faults.values(), self.illegal, cost, "".join(self.audit), self.hash.hexdigest())


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPAIRED = "at long, edit string, role string, text string"


def or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and dropped of rows that crc32 of `conv_id:turn` spoils; nulls in it, in role and in text
    are one space. Of 20 remainders 0 drops the row (it stays with the mark dropped, an empty role and an empty text), 1
    empties its text, 2 takes `.`, `!` and `?` out, 3 repeats it, 4 makes it a user's."""
    how = (F.crc32(F.concat(or_space(F.col("conv_id")), F.lit(":"), or_space(F.col("turn")))) % 20).alias("how")
    d = rows.select("conv_id", "turn", or_space(F.col("role")).alias("role"), or_space(F.col("text")).alias("text"), how)
    gone, text = F.col("how") == 0, F.col("text")
    return d.select(
        "conv_id",
        "turn",
        F.when(gone, "").when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("how") == 1), "").when(F.col("how") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        gone.alias("dropped"),
        F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text, dropped), each conversation in one partition and in order, with fault: the first of
    blank, duplicate (its role and text came before in the conversation) and truncated that holds, else null."""
    last = F.substring(F.btrim("text", F.lit(SPACES)), -1, 1)
    same = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    fault = (
        F.when(F.col("dropped"), None)
        .when(last == "", "blank")
        .when(F.row_number().over(same) > 1, "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
    )
    dealt = rows.repartition("conv_id").withColumn("fault", fault)
    repeated = F.coalesce(F.col("fault") == "duplicate", F.lit(False))  # of equal rows of a turn the first is not
    return dealt.sortWithinPartitions("conv_id", *[F.col(c).asc_nulls_first() for c in ORDER], repeated)


def _streamed(rows: DataFrame, columns: str, turns: bool) -> DataFrame:
    ship_package(rows.sparkSession)
    schema = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string(columns)])
    names = ["conv_id", "turn", "role", "text", "dropped", "fault"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, held, arrow = [], None, to_arrow_schema(schema)
        sink = (lambda *x: out.append(x)) if turns else None

        def flush() -> pa.RecordBatch:
            whole = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
            out.clear()
            return whole

        for batch in batches:
            for conv_id, turn, role, text, dropped, fault in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True):
                if held is None or held.conv_id != conv_id:
                    if held is not None:
                        done = held.finish()
                        out.extend([] if turns else [done])
                    held = Conversation(conv_id, sink)
                if not dropped:
                    held.add(turn, role, text, fault)
                if len(out) >= 500:
                    yield flush()
        if held is not None:
            done = held.finish()
            out.extend([] if turns else [done])
        if out:
            yield flush()

    return with_faults(rows).select(*names).mapInArrow(run, schema)


def repair_summary(rows: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows has conv_id, turn, role, text and dropped; a dropped row only keeps its conversation in the result. Role and text
    must not be null. The hash of a repair runs over its turns in order, so a conversation's rows pass through one
    task; they come sorted from Spark, which spills, and the task holds the undecided ones and the edits' letters alone.
    Turns count with nulls first; rows of the same turn are ordered by role and text, so repeated rows are neighbours. A
    null conv_id is a conversation. An empty table gives an empty result; other columns are not read.
    """
    return _streamed(rows, SUMMARY, False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The edits of repair_summary as rows: conv_id, at (from 0), edit (K, R, D or I), and role and text as they are afterwards
    (a deleted row's own)."""
    return _streamed(rows, REPAIRED, True)


def repair_report(conversations: DataFrame) -> DataFrame:
    """repair_summary of the damaged table; one row for each original conv_id."""
    return repair_summary(damaged(conversations))


SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k FROM conversations),
c AS (SELECT *, xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::bigint),
        lambda s, b: list_reduce(range(8), lambda t, i: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384::bigint) ELSE t >> 1 END, xor(s, b)), 4294967295::bigint), 4294967295::bigint) % 20 AS how FROM o),
d AS (SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE how WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE how <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             right(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last, substr(role, 1, 1) AS r FROM d),
f AS (SELECT conv_id, i, turn, role, text, r, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
             lag(r) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM n),
ins AS (SELECT * FROM (VALUES ('0', '0', '', 0), ('0', 'U', 'I', 3), ('0', 'A', 'II', 6), ('S', 'S', '', 0), ('S', 'U', 'I', 3), ('S', 'A', 'II', 6),
                              ('A', 'A', '', 0), ('A', 'U', 'I', 3), ('U', 'U', '', 0), ('U', 'A', 'I', 3)) AS t(a, b, l, c)),
steps AS (SELECT * FROM (VALUES ('0', '0', 'D', 4, NULL), ('S', 'S', 'D', 4, NULL), ('U', 'U', 'D', 4, NULL), ('A', 'A', 'D', 4, NULL),
                                ('0', 'S', 'K', 0, 's'), ('0', 'U', 'K', 0, 'u'), ('S', 'U', 'K', 0, 'u'), ('A', 'U', 'K', 0, 'u'), ('U', 'A', 'K', 0, 'a'),
                                ('0', 'U', 'R', 3, NULL), ('S', 'U', 'R', 3, NULL), ('A', 'U', 'R', 3, NULL), ('U', 'A', 'R', 3, NULL)) AS t(a, b, l, c, r)),
v AS (SELECT conv_id, 0::bigint AS i, b AS s, {'c': c::bigint, 'l': l} AS w FROM (SELECT DISTINCT conv_id FROM f) CROSS JOIN ins WHERE a = '0'
      UNION ALL
      SELECT v.conv_id, f.i, ins.b, min({'c': v.w.c + steps.c + ins.c + CASE WHEN steps.l <> 'D' AND f.fault = 'truncated' THEN 3 ELSE 0 END, 'l': v.w.l || steps.l || ins.l})
      FROM v JOIN f ON v.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = v.i + 1 JOIN steps ON steps.a = v.s AND (steps.r IS NULL OR steps.r = f.r) JOIN ins ON ins.a = steps.b
      WHERE steps.l = 'D' OR f.fault IS NULL OR f.fault = 'truncated' GROUP BY v.conv_id, f.i, ins.b),
e AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND before || r NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
w AS (SELECT e.conv_id, min(v.w) AS w FROM e JOIN v ON e.conv_id IS NOT DISTINCT FROM v.conv_id AND v.i = e.n WHERE v.s IN ('0', 'A') GROUP BY e.conv_id),
p AS (SELECT conv_id, unnest(range(1, length(w.l) + 1)) AS pos, w.l AS audit FROM w),
q AS (SELECT conv_id, pos, audit[pos] AS l, length(replace(audit[:pos], 'I', '')) AS i, length(replace(audit[:pos], 'D', '')) AS j FROM p),
x AS (SELECT q.conv_id, q.pos, q.l, q.j, f.role, f.text, bool_or(q.l = 'K' AND q.j = 1 AND f.r = 's') OVER (PARTITION BY q.conv_id) AS s
      FROM q LEFT JOIN f ON q.conv_id IS NOT DISTINCT FROM f.conv_id AND q.i = f.i AND q.l <> 'I' WHERE q.l <> 'D'),
y AS (SELECT conv_id, string_agg(CASE l WHEN 'K' THEN role ELSE CASE WHEN (j + s::int) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE l WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY pos) AS t FROM x GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated,
       coalesce(illegal, 0)::bigint AS illegal, coalesce(w.w.c, 0)::bigint AS cost, coalesce(w.w.l, '') AS audit, sha256(coalesce(y.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN e ON o.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN w ON o.conv_id IS NOT DISTINCT FROM w.conv_id LEFT JOIN y ON o.conv_id IS NOT DISTINCT FROM y.conv_id
"""
