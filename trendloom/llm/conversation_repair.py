"""Repair of conversation structure at least cost, by Four-Russians block tables.

A conversation is right if its role initials read ``(s?(ua)+)?``.  Each row is one
of nine symbols: it has to go (blank or duplicate), or its role is s, u, a or
another, truncated or not.  Read from the end, a row turns the costs of finishing
from the four states (nothing yet, after s, after u, after a) into new ones.  Less
their smallest, there are only a few such cost vectors; so for every vector and every
block of ``BLOCK`` symbols the next vector is computed once, and a conversation is
processed by one lookup a block.  Only the vectors between blocks are kept.  The
edits are then read off forwards: a block is expanded backward from the vector
behind it, and of the edits that keep the cost least the one whose initial comes
first is taken (in each state only one role can be inserted or given, so the initials
say all).  Expansions are remembered by vector, block and state.

Rows are dealt by ranges of (conversation, turn, role, text) and cut into chunks, so
a conversation of any length lies in many tasks.  A chunk that holds its conversation
whole is repaired where it is.  The others first tell duplicates across chunks by the
digests of their distinct rows, then what they make of each cost vector (a list as long
as the vectors are many); those lists are composed for each conversation from the end,
the chunks traced from each state, and the states composed from the start.

Defined results: rows of a conversation are taken by turn, nulls first, then by
role, text and place in the input; a null conversation is one of its own; null roles
and texts are one space; repeated rows are duplicates; an empty table gives an empty
table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import stored

SPACE = " \t\n\x0b\x0c\r"
BLOCK = 4
CHUNK_ROWS, CHUNK_BYTES = 1 << 16, 8 << 20
#: Costs of the edits.
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
START, S, U, A = range(4)
GONE, SYMBOLS = 8, 9  # symbols 0-3: role s, u, a or another; 4-7: the same, truncated; 8: has to go
KEPT = {(START, "s"): S, (START, "u"): U, (S, "u"): U, (U, "a"): A, (A, "u"): U}
NEXT = (U, U, A, U)  # the state after inserting or giving the one role that is right there
ROLE = {U: "user", A: "assistant"}
END_COSTS = (0, 2 * INSERT, INSERT, 0)
CHUNK_SCHEMA = ("conv_id long, conv string, part int, seq int, whole boolean, turns array<long>, roles array<string>, "
                "texts array<string>, flags binary")
REPAIRED_SCHEMA = ("conv_id long, conv string, part int, seq int, whole boolean, min_turn long, max_turn long, n_turns long, "
                   "first_role string, last_role string, blank long, duplicate long, truncated long, illegal long, cost long, "
                   "audit string, roles array<string>, texts array<string>")


class Tables:
    """Vectors of costs and what symbols and blocks of symbols make of them."""

    def __init__(self, block: int = BLOCK):
        self.block, self.known, self.vectors, steps, added = block, {}, [], [], []
        self.end = self._number(END_COSTS)
        while len(steps) < len(self.vectors):
            rows = [self._back(self.vectors[len(steps)], symbol) for symbol in range(SYMBOLS)]
            steps.append([self._number(tuple(c - min(r) for c in r)) for r in rows])
            added.append([min(r) for r in rows])
        self.step, self.added = steps, added
        one = table = np.array(steps, np.int32)
        for _ in range(block - 1):  # a symbol before all shorter blocks
            table = one[table].transpose(0, 2, 1).reshape(len(one), -1)
        self.table, self.rows, self.weights = table, table.tolist(), SYMBOLS ** np.arange(block - 1, -1, -1)
        self.memo: dict[tuple, tuple[str, int]] = {}

    def _number(self, vector: tuple) -> int:
        if vector not in self.known:
            self.known[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.known[vector]

    @staticmethod
    def _edits(behind: tuple, symbol: int, state: int):
        """(letter, cost of finishing with it, state after it) of the edits that use up the row."""
        yield "D", DELETE + behind[state], state
        if symbol != GONE:
            more, role = TRUNCATED * (symbol >= 4), "sua "[symbol % 4]
            if (state, role) in KEPT:
                yield "K", more + behind[KEPT[state, role]], KEPT[state, role]
            yield "R", REROLE + more + behind[NEXT[state]], NEXT[state]

    def _back(self, behind: tuple, symbol: int) -> tuple:
        """Costs of finishing before a row, given those behind it."""
        costs = [min(c for _, c, _ in self._edits(behind, symbol, s)) for s in range(4)]
        for _ in range(2):  # two insertions come back to the same place
            costs = [min(costs[s], INSERT + costs[NEXT[s]]) for s in range(4)]
        return tuple(costs)

    def blocks(self, symbols: np.ndarray) -> tuple[list[int], list[int]]:
        """The symbols before the first whole block, and the numbers of the blocks."""
        head = len(symbols) % self.block
        return symbols[:head].tolist(), (symbols[head:].reshape(-1, self.block) @ self.weights).tolist()

    def through(self, symbols: np.ndarray) -> list[int]:
        """The vector before the symbols, for each vector behind them."""
        head, blocks = self.blocks(symbols)
        at = np.arange(len(self.vectors))
        for b in reversed(blocks):
            at = self.table[at, b]
        for symbol in reversed(head):
            at = np.array(self.step)[at, symbol]
        return at.tolist()

    def _expand(self, symbols: list[int], behind: int, state: int) -> tuple[str, int]:
        """Letters and state after them, of a few symbols."""
        after = [behind]
        for symbol in reversed(symbols):
            after.append(self.step[after[-1]][symbol])
        after.reverse()  # after[i]: the vector before symbol i
        letters = []
        for i, symbol in enumerate(symbols):
            here, added = self.vectors[after[i]], self.added[after[i + 1]][symbol]
            while True:
                least = here[state] + added
                found = [e for e in self._edits(self.vectors[after[i + 1]], symbol, state) if e[1] == least]
                if found and found[0][0] == "D" or here[NEXT[state]] + INSERT != here[state]:
                    letter, _, state = found[0]
                    letters.append(letter)
                    break
                letters.append("I")
                state = NEXT[state]
        return "".join(letters), state

    def trace(self, symbols: np.ndarray, behind: int, state: int, last: bool) -> tuple[str, int]:
        """The edits' initials from ``state``, and the state after them;
        ``last``: the conversation ends here."""
        head, blocks = self.blocks(symbols)
        between = [behind]
        for b in reversed(blocks):
            between.append(self.rows[between[-1]][b])
        between.reverse()
        letters = []
        if head:
            found, state = self._expand(head, between[0], state)
            letters.append(found)
        for b, after in zip(blocks, between[1:], strict=True):
            key = (b, after, state)
            got = self.memo.get(key)
            if got is None:
                got = self.memo[key] = self._expand([b // int(w) % SYMBOLS for w in self.weights], after, state)
            letters.append(got[0])
            state = got[1]
        while last and state not in (START, A):
            letters.append("I")
            state = NEXT[state]
        return "".join(letters), state


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage: conv_id, turn, role, text and ``present`` (false
    for dropped rows, which only say that their conversation exists)."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = (F.crc32(key.cast("binary")) % 20).cast("int")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                                F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = (F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (F.col("kind") != 0).alias("present"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"))
    return rows.drop("copy")


def _chunker(chunk_rows: int, chunk_bytes: int):
    """Sorted rows to chunks of one conversation."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext
        part, seq, now, rows, size, cut, first = TaskContext.get().partitionId(), 0, None, [], 0, True, True
        schema = pa.schema([("conv_id", pa.int64()), ("conv", pa.string()), ("part", pa.int32()), ("seq", pa.int32()),
                            ("whole", pa.bool_()), ("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())),
                            ("texts", pa.list_(pa.string())), ("flags", pa.binary())])
        made: list[tuple] = []

        def chunk(whole: bool):
            turns, roles, texts, flags = [list(c) for c in zip(*rows)] if rows else ([], [], [], [])
            made.append((now[0], "" if now[0] is None else str(now[0]), part, seq, whole, turns, roles, texts, bytes(flags)))

        def table():
            columns = [pa.array(c, t) for c, t in zip(zip(*made), schema.types, strict=True)]
            made.clear()
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            for conv, turn, role, text, present, flag in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now[0] != conv:
                    if now is not None:  # the first conversation may have begun in an earlier part
                        chunk(not cut)
                        seq, first = seq + 1, False
                    now, rows, size, cut = (conv,), [], 0, first
                elif len(rows) >= chunk_rows or size >= chunk_bytes:
                    chunk(False)
                    seq, rows, size, cut = seq + 1, [], 0, True
                if present:
                    rows.append((turn, role, text, flag))
                    size += len(text)
            if len(made) >= 64:
                yield table()
        if now is not None:  # the last one may go on in a later part
            chunk(False)
        if made:
            yield table()
    return run


def chunks(rows: DataFrame, present: Column | None = None, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES,
           num_partitions: int | None = None) -> DataFrame:
    """Conversations cut into chunks, written; (part, seq) is their order."""
    bare = F.btrim("text", F.lit(SPACE))
    flag = F.when(bare == "", 1).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), 2).otherwise(0)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
                       (F.lit(True) if present is None else present).alias("present"))
    rows = rows.select("*", flag.alias("flag"), F.monotonically_increasing_id().alias("at"))
    # equal rows, too, can lie in several parts: the place in the input is the last key
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("at")]
    dealt = rows.repartitionByRange(num_partitions, *keys) if num_partitions else rows.repartitionByRange(*keys)
    dealt = dealt.sortWithinPartitions(*keys).select("conv_id", "turn", "role", "text", "present", "flag")
    return stored(dealt.mapInArrow(_chunker(chunk_rows, chunk_bytes), CHUNK_SCHEMA), "conversation-chunks")


def _symbols(roles: list[str], texts: list[str], flags: bytes, late: list[int]) -> tuple[np.ndarray, int, int, int]:
    """Symbols of a chunk's rows and how many are blank, duplicate, truncated."""
    seen, out, earlier, counts = set(), np.empty(len(roles), np.int64), set(late), [0, 0, 0]
    for i, (role, text, flag) in enumerate(zip(roles, texts, flags, strict=True)):
        again = (role, text) in seen or i in earlier
        seen.add((role, text))
        kind = 0 if flag == 1 else 1 if again else 2 if flag == 2 else None
        if kind is not None:
            counts[kind] += 1
        at = "sua".find(role[:1]) if role[:1] else -1
        out[i] = GONE if kind in (0, 1) else (at if at >= 0 else 3) + 4 * (kind == 2)
    return out, *counts


def _repaired(row: dict, counts: tuple, audit: str, state: int) -> tuple:
    """A chunk's row of the result."""
    roles, texts, turns = row["roles"], row["texts"], [t for t in row["turns"] if t is not None]
    symbols, blank, duplicate, truncated = counts
    initials = [r[:1] for r in roles]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    new_roles, new_texts, cost, i = [], [], 0, 0
    for letter in audit:
        if letter == "D":
            cost += DELETE
            i += 1
            continue
        if letter == "K":
            new_roles.append(roles[i])
            state = KEPT[state, initials[i]]
        else:
            state = NEXT[state]
            new_roles.append(ROLE[state])
            cost += INSERT if letter == "I" else REROLE
        if letter == "I":
            new_texts.append("")
        else:
            new_texts.append(texts[i])
            cost += TRUNCATED * bool(symbols[i] >= 4)
            i += 1
    return (row["conv_id"], row["conv"], row["part"], row["seq"], row["whole"], min(turns, default=None), max(turns, default=None),
            len(set(turns)), initials[0] if roles else None, initials[-1] if roles else None, blank, duplicate, truncated, illegal, cost,
            audit, new_roles, new_texts)


def _arrow(schema: str):
    """The Arrow form of a schema, on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(schema))


def _rows_out(schema: str, make):
    """mapInArrow over rows as dicts; ``make`` gives the tuples of one row."""
    arrow = _arrow(schema)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                found = [t for row in batch.slice(lo, 256).to_pylist() for t in make(row)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow, strict=True)], schema=arrow)
    return run


def _whole(row: dict):
    t, counts = tables(), _symbols(row["roles"], row["texts"], row["flags"], [])
    yield _repaired(row, counts, t.trace(counts[0], t.end, START, True)[0], START)


def _summary(row: dict):
    symbols = _symbols(row["roles"], row["texts"], row["flags"], row["late"])[0]
    yield row["conv"], row["part"], row["seq"], symbols.astype(np.uint8).tobytes(), tables().through(symbols)


def _from_behind(pdf):
    pdf, at, end = pdf.sort_values(["part", "seq"], ascending=False), tables().end, True
    behind, last = [], []
    for through in pdf["through"]:
        behind.append(at)
        last.append(end)
        at, end = int(through[at]), False
    return pdf.assign(behind=behind, last=last)[["part", "seq", "behind", "last"]]


def _traced(row: dict):
    symbols = np.frombuffer(row["symbols"], np.uint8).astype(np.int64)
    found = [tables().trace(symbols, row["behind"], state, row["last"]) for state in range(4)]
    yield row["conv"], row["part"], row["seq"], [f[0] for f in found], [f[1] for f in found]


def _from_start(pdf):
    pdf, state, states = pdf.sort_values(["part", "seq"]), START, []
    for after in pdf["after"]:
        states.append(state)
        state = int(after[state])
    return pdf.assign(state=states)[["part", "seq", "state"]]


def _chosen(row: dict):
    yield _repaired(row, _symbols(row["roles"], row["texts"], row["flags"], row["late"]), row["audits"][row["state"]], row["state"])


def repair(rows: DataFrame, present: Column | None = None, chunk_rows: int = CHUNK_ROWS, chunk_bytes: int = CHUNK_BYTES,
           num_partitions: int | None = None) -> DataFrame:
    """The repaired chunks of all conversations in the order (part, seq):
    REPAIRED_SCHEMA, with the repaired roles and texts, the edits' initials and
    the counts of the chunk.  A chunk marked ``whole`` is its conversation."""
    cut = chunks(rows, present, chunk_rows, chunk_bytes, num_partitions)
    whole = cut.where("whole").mapInArrow(_rows_out(REPAIRED_SCHEMA, _whole), REPAIRED_SCHEMA)
    parts, at = cut.where("not whole"), ["part", "seq"]
    # duplicates of rows in earlier chunks: the first place of each distinct row of a chunk
    said = parts.select("conv", *at, F.posexplode(F.arrays_zip("roles", "texts"))).groupBy(
        "conv", *at, F.sha2(F.concat(F.length("col.roles"), F.lit(":"), "col.roles", "col.texts"), 256).alias("key")).agg(F.min("pos").alias("pos"))
    first = said.groupBy("conv", "key").agg(F.min(F.struct(*at)).alias("first"))
    late = said.join(first, ["conv", "key"]).where(F.struct(*at) > F.col("first")).groupBy(*at).agg(F.collect_list("pos").alias("late"))
    parts = parts.join(late, at, "left").withColumn("late", F.coalesce("late", F.array().cast("array<int>")))
    parts = stored(parts, "conversation-parts")
    summary = "conv string, part int, seq int, symbols binary, through array<int>"
    sums = stored(parts.select("conv", *at, "roles", "texts", "flags", "late").mapInArrow(_rows_out(summary, _summary), summary), "part-sums")
    behind = sums.select("conv", *at, "through").groupBy("conv").applyInPandas(_from_behind, "part int, seq int, behind int, last boolean")
    traced = "conv string, part int, seq int, audits array<string>, after array<int>"
    traces = stored(sums.join(behind, at).select("conv", *at, "symbols", "behind", "last").mapInArrow(_rows_out(traced, _traced), traced), "part-traces")
    states = traces.select("conv", *at, "after").groupBy("conv").applyInPandas(_from_start, "part int, seq int, state int")
    chosen = parts.join(traces.drop("conv", "after"), at).join(states, at).mapInArrow(_rows_out(REPAIRED_SCHEMA, _chosen), REPAIRED_SCHEMA)
    return whole.unionByName(chosen)


AUDIT_SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
                "repaired_sha256 string")


def _folder():
    """Chunks sorted by conversation and place to one row for each conversation;
    the digest runs over the texts as they come."""
    arrow = _arrow(AUDIT_SCHEMA)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        now, out = None, []

        def done():
            lo, hi, turns = now["lo"], now["hi"], now["turns"]
            out.append((now["conv_id"], 0 if lo is None else hi - lo + 1 - turns, *now["sums"], "".join(now["audit"]), now["sha"].hexdigest()))

        def table():
            columns = [pa.array(c, f.type) for c, f in zip(zip(*out), arrow, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or now["conv"] != row["conv"]:
                    if now is not None:
                        done()
                    now = {"conv": row["conv"], "conv_id": row["conv_id"], "lo": None, "hi": None, "turns": 0, "sums": [0] * 5, "audit": [],
                           "sha": hashlib.sha256(), "role": None, "any": False}
                for j, c in enumerate(("blank", "duplicate", "truncated", "illegal", "cost")):
                    now["sums"][j] += row[c]
                if row["first_role"] is not None:
                    if now["role"] is not None:
                        now["sums"][3] += now["role"] + row["first_role"] not in ("su", "ua", "au")
                    now["role"] = row["last_role"]
                if row["min_turn"] is not None:
                    now["turns"] += row["n_turns"] - (now["hi"] == row["min_turn"])
                    now["lo"], now["hi"] = row["min_turn"] if now["lo"] is None else now["lo"], row["max_turn"]
                now["audit"].append(row["audit"])
                for role, text in zip(row["roles"], row["texts"], strict=True):
                    now["sha"].update((("\n" if now["any"] else "") + role + ":" + text).encode())
                    now["any"] = True
                if len(out) >= 1000:
                    yield table()
        if now is not None:
            done()
        if out:
            yield table()
    return run


def audits(rows: DataFrame, **options) -> DataFrame:
    """One row for each conversation of ``rows`` (those of ``damaged``).  The
    digest of one conversation is one chain by definition: the task that has it
    reads its chunks in order and holds one of them."""
    found = repair(rows, F.col("present"), **options)
    lines = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
    whole = found.where("whole").select(
        "conv_id", F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps"), "blank", "duplicate",
        "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("repaired_sha256"))
    parts = found.where("not whole").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return whole.unionByName(parts.mapInArrow(_folder(), AUDIT_SCHEMA))


#: The damage by a bitwise crc32; the cheapest edits by a forward search over whole strings, row after row.
ORACLE_SQL = r"""
WITH RECURSIVE keyed AS (
  SELECT row_number() OVER () AS place, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
), hashed AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(k) + 1),
           lambda i: [ord(k[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS kind
  FROM keyed
), damaged AS (
  SELECT place, conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM hashed WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, place, copy) AS i,
         trim(text, E' \t\n\x0B\x0C\r') AS bare
  FROM damaged
), faults AS (
  SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM numbered
), symbols AS (
  SELECT *, blank OR again AS gone, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut, left(role, 1) AS one,
         role || ':' || text AS line
  FROM faults
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (again) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || one NOT IN ('su', 'ua', 'au')) AS illegal
  FROM symbols GROUP BY conv_id
), search AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'a': '', 'r': []::VARCHAR[]} AS p0, {'c': 1000000, 'a': '', 'r': []::VARCHAR[]} AS ps,
         {'c': 2, 'a': 'I', 'r': ['user:']} AS pu, {'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']} AS pa
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, p0, ps, pu, list_min([pa, {'c': pu.c + 2, 'a': pu.a || 'I', 'r': list_append(pu.r, 'assistant:')}])
  FROM (
    SELECT conv_id, i, p0, ps, pa, list_min([pu, {'c': p0.c + 2, 'a': p0.a || 'I', 'r': list_append(p0.r, 'user:')},
             {'c': ps.c + 2, 'a': ps.a || 'I', 'r': list_append(ps.r, 'user:')},
             {'c': pa.c + 2, 'a': pa.a || 'I', 'r': list_append(pa.r, 'user:')}]) AS pu
    FROM (
      SELECT d.conv_id, o.i, {'c': p0.c + 3, 'a': p0.a || 'D', 'r': p0.r} AS p0,
        list_min([{'c': ps.c + 3, 'a': ps.a || 'D', 'r': ps.r},
          {'c': p0.c + CASE WHEN gone OR one <> 's' THEN 1000000 ELSE cut::INT END, 'a': p0.a || 'K', 'r': list_append(p0.r, line)}]) AS ps,
        list_min([{'c': pu.c + 3, 'a': pu.a || 'D', 'r': pu.r},
          {'c': p0.c + CASE WHEN gone OR one <> 'u' THEN 1000000 ELSE cut::INT END, 'a': p0.a || 'K', 'r': list_append(p0.r, line)},
          {'c': ps.c + CASE WHEN gone OR one <> 'u' THEN 1000000 ELSE cut::INT END, 'a': ps.a || 'K', 'r': list_append(ps.r, line)},
          {'c': pa.c + CASE WHEN gone OR one <> 'u' THEN 1000000 ELSE cut::INT END, 'a': pa.a || 'K', 'r': list_append(pa.r, line)},
          {'c': p0.c + CASE WHEN gone THEN 1000000 ELSE 2 + cut::INT END, 'a': p0.a || 'R', 'r': list_append(p0.r, 'user:' || text)},
          {'c': ps.c + CASE WHEN gone THEN 1000000 ELSE 2 + cut::INT END, 'a': ps.a || 'R', 'r': list_append(ps.r, 'user:' || text)},
          {'c': pa.c + CASE WHEN gone THEN 1000000 ELSE 2 + cut::INT END, 'a': pa.a || 'R', 'r': list_append(pa.r, 'user:' || text)}]) AS pu,
        list_min([{'c': pa.c + 3, 'a': pa.a || 'D', 'r': pa.r},
          {'c': pu.c + CASE WHEN gone OR one <> 'a' THEN 1000000 ELSE cut::INT END, 'a': pu.a || 'K', 'r': list_append(pu.r, line)},
          {'c': pu.c + CASE WHEN gone THEN 1000000 ELSE 2 + cut::INT END, 'a': pu.a || 'R', 'r': list_append(pu.r, 'assistant:' || text)}]) AS pa
      FROM search d JOIN symbols o ON o.conv_id IS NOT DISTINCT FROM d.conv_id AND o.i = d.i + 1
    )
  )
), finished AS (
  SELECT conv_id, list_min([p0, pa]) AS best FROM search
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1
)
SELECT f.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, f.best.c::BIGINT AS cost, f.best.a AS audit,
       sha256(array_to_string(f.best.r, chr(10))) AS repaired_sha256
FROM finished f LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM f.conv_id
"""
