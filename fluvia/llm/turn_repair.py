"""Repair of the turn structure of conversations by Wagner-Fischer alignment with the alternating grammar.

The rows of a conversation are aligned with each feasible length of the string ``(s?(ua)+)?``. A table is filled only
inside Ukkonen's band: cells whose deletions and insertions alone cost no more than the incumbent, the best alignment
so far. Lengths come in the order of their least possible cost, and among equal costs the backtraced audits decide.

Conversations of more than ``WHOLE`` rows use the same table folded: cells of one row at equal grammar state have the
same future, so each state keeps its cheapest. That takes time in proportion to the rows and gives the same audits.

Texts never meet in a group. One pass over sorted rows sees a symbol for each row and gives the edits; a second streams
the texts of a conversation past its edits into a digest. A task holds one byte for each row of one conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Rows up to which a conversation is aligned with every feasible length.
WHOLE = 64
#: Edits of a row of output, and rows between kept costs of the folded table.
PIECE = 1 << 16
_BLANK = " \t\n\x0b\x0c\r"
_NEVER = 1 << 60
#: States of the grammar: nothing yet, after s, after u, after a; and where a turn of the user or assistant leads.
_NEXT = (2, 2, 3, 2)
_TAKES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}


def _fit(symbol: str, turn: str) -> tuple[int, str]:
    """Cost and letter of turning a row into a turn of the target."""
    if symbol == "x":
        return _NEVER, ""
    extra = TRUNCATED * symbol.isupper()
    if symbol.lower() == turn:
        return extra, "K"
    return (_NEVER, "") if turn == "s" else (REROLE + extra, "R")


def align(symbols: str, target: str, limit: int) -> tuple[int, str] | None:
    """The least cost, up to ``limit``, of editing ``symbols`` into ``target``, and its ASCII-least audit."""
    n, m = len(symbols), len(target)
    forced = [0]
    for c in symbols:
        forced.append(forced[-1] + (c == "x"))

    def least(rows: int, must: int, turns: int) -> int:
        return DELETE * max(must, rows - turns) + INSERT * max(0, turns - rows + must)

    rest: list[dict[int, int]] = [{} for _ in range(n + 1)]  # costs from a cell to the end, inside the band
    for i in range(n, -1, -1):
        here = rest[i]
        below = rest[i + 1] if i < n else {}
        for j in range(m, -1, -1):
            if least(i, forced[i], j) + least(n - i, forced[n] - forced[i], m - j) > limit:
                continue
            cost = 0 if i == n and j == m else min(DELETE + below.get(j, _NEVER), INSERT + here.get(j + 1, _NEVER))
            if i < n and j < m:
                cost = min(cost, _fit(symbols[i], target[j])[0] + below.get(j + 1, _NEVER))
            here[j] = cost
    if rest[0].get(0, _NEVER) > limit:
        return None
    i, j, audit = 0, 0, []
    while (i, j) != (n, m):
        cost = rest[i][j]
        if i < n and DELETE + rest[i + 1].get(j, _NEVER) == cost:
            audit.append("D")
            i += 1
        elif INSERT + rest[i].get(j + 1, _NEVER) == cost:
            audit.append("I")
            j += 1
        else:
            audit.append(_fit(symbols[i], target[j])[1])
            i, j = i + 1, j + 1
    return rest[0][0], "".join(audit)


@lru_cache(1 << 15)
def aligned(symbols: str) -> tuple[int, str]:
    """The cheapest edits over all feasible lengths of the grammar's string; ties go to the ASCII-least audit."""
    n, forced = len(symbols), symbols.count("x")
    best = (DELETE * n, "D" * n)
    starts = [0, 1] if "s" in symbols.lower() else [0]
    lengths = [s + 2 * k for s in starts for k in range(1, n + 2)]
    lengths = sorted((DELETE * max(forced, n - m) + INSERT * max(0, m - n + forced), m) for m in lengths)
    for least, m in lengths:
        if least > best[0]:
            break
        found = align(symbols, "s" * (m % 2) + "ua" * (m // 2), best[0])
        best = min(best, found) if found else best
    return best


def _before(symbol: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end by state before a row, from those after it."""
    costs = [DELETE + c for c in after]
    if symbol != "x":
        for s in range(4):
            for turn in "sua":
                to = _TAKES.get((s, turn))
                if to is not None:
                    costs[s] = min(costs[s], _fit(symbol, turn)[0] + after[to])
    return _inserted(costs)


def _inserted(c: list[int]) -> tuple[int, ...]:
    after_u, after_a = min(c[2], INSERT + c[3]), min(c[3], INSERT + c[2])
    return min(c[0], INSERT + after_u), min(c[1], INSERT + after_u), after_u, after_a


_END = _inserted([0, _NEVER, _NEVER, 0])


def folded(symbols: str) -> tuple[int, Iterator[str]]:
    """As ``aligned``, by the folded table: the cost, and the audit in pieces."""
    marks, costs = {len(symbols): _END}, _END
    for i in range(len(symbols) - 1, -1, -1):
        costs = _before(symbols[i], costs)
        if i % PIECE == 0:
            marks[i] = costs
    return costs[0], _walk(symbols, marks)


def _walk(symbols: str, marks: dict[int, tuple[int, ...]]) -> Iterator[str]:
    states, n = {0}, len(symbols)
    for at in range(0, n + 1, PIECE):
        end, audit = min(n, at + PIECE), []
        costs = [marks[end]]
        for i in range(end - 1, at - 1, -1):
            costs.append(_before(symbols[i], costs[-1]))
        costs.reverse()
        i = at
        while i < end or (i == n and costs[i - at][min(states)] > 0):
            here, after = costs[i - at], costs[i - at + 1] if i < end else None
            ways: dict[str, set[int]] = {"D": set(), "I": set(), "K": set(), "R": set()}
            for s in states:
                if after and DELETE + after[s] == here[s]:
                    ways["D"].add(s)
                if INSERT + here[_NEXT[s]] == here[s]:
                    ways["I"].add(_NEXT[s])
                for turn in "sua" if after and symbols[i] != "x" else "":
                    to = _TAKES.get((s, turn))
                    cost, letter = _fit(symbols[i], turn)
                    if to is not None and cost + after[to] == here[s]:
                        ways[letter].add(to)
            letter = next(w for w in "DIKR" if ways[w])
            audit.append(letter)
            states = ways[letter]
            i += letter != "I"
        yield "".join(audit)
        if end == n:
            return


def damaged(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, turn, role, text, gone)`` after the damage by ``crc32(conv:turn) % 20``; rows that it drops stay, marked
    ``gone``, so that every conversation is seen. Nulls of what is read as text are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(
        F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), space(role).alias("role"), space(text).alias("text"),
        (F.crc32(F.concat(space(conv), F.lit(":"), space(turn))) % 20).alias("code"),
    )
    code = F.col("code")
    text_now = F.when(code == 1, "").when(code == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    own = own.select(
        "conv", "turn", F.when(code == 4, "user").otherwise(F.col("role")).alias("role"), text_now.alias("text"), (code == 0).alias("gone"),
        F.explode(F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return own.drop("copy")


def _initial(role: str = "role") -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first.isin("s", "u", "a"), first).otherwise("o")


def _wrapped(x: int) -> int:
    """As a 64-bit integer."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _batches(rows: Iterator[dict], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    waiting, size = [], 0
    for row in rows:
        waiting.append(row)
        size += 256 + len(row["audit"])
        if size >= 1 << 20:
            yield pa.RecordBatch.from_pylist(waiting, kind)
            waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, kind)


def _edits(rows: Iterator[dict]) -> Iterator[dict]:
    """Sorted symbols -> the counts of each conversation and its audit in pieces."""
    for conv, group in groupby(rows, key=lambda r: r["conv"]):
        symbols, counts = bytearray(), dict.fromkeys(_COUNTS, 0)
        first = last = before = None
        distinct = 0
        for r in group:
            if r["gone"]:
                continue
            if r["turn"] is not None:
                distinct += r["turn"] != last
                first, last = r["turn"] if first is None else first, r["turn"]
            fault = r["fault"]
            if fault != "none":
                counts[fault] += 1
            counts["illegal"] += before is not None and before + r["initial"] not in ("su", "ua", "au")
            before = r["initial"]
            symbols += (b"x" if fault in ("blank", "duplicate") else before.upper().encode() if fault == "truncated" else before.encode())
        if first is not None:
            counts["gaps"] = _wrapped(last - first + 1 - distinct)
        line = symbols.decode()
        if len(line) <= WHOLE:
            counts["cost"], audit = aligned(line)
            pieces = iter([audit])
        else:
            counts["cost"], pieces = folded(line)
        for part, piece in enumerate(pieces):
            yield {"conv": conv, "part": part, "audit": piece} | counts


def _digests(rows: Iterator[dict]) -> Iterator[dict]:
    """Edits, then texts in order, of each conversation -> its result."""
    for conv, group in groupby(rows, key=lambda r: r["conv"]):
        pieces, digest, at, state, audit, some, head = [], hashlib.sha256(), 0, 0, None, False, {}

        def put(role: str, text: str) -> None:
            nonlocal some
            digest.update(("\n" if some else "").encode() + role.encode("utf-8", "surrogatepass") + b":")
            digest.update(text.encode("utf-8", "surrogatepass"))
            some = True

        def inserted() -> None:
            nonlocal at, state
            while at < len(audit) and audit[at] == "I":
                state = _NEXT[state]
                put("user" if state == 2 else "assistant", "")
                at += 1

        for r in group:
            if r["part"] is not None:
                head = head or r
                pieces.append(r["audit"])
                continue
            if audit is None:
                audit = "".join(pieces)
            inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = {"s": 1, "u": 2, "a": 3}[r["role"][:1]]
                put(r["role"], r["text"])
            elif edit == "R":
                state = _NEXT[state]
                put("user" if state == 2 else "assistant", r["text"])
        audit = "".join(pieces) if audit is None else audit
        inserted()
        yield {"conv": conv, "audit": audit, "sha": digest.hexdigest()} | {c: head[c] for c in _COUNTS}


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for every value of ``conv``, null included: counts of faults, the cost and audit of the cheapest repair
    of its damaged rows, and the digest of the repaired turns.

    Rows go by ``turn``, nulls first; rows of equal turns by role, then by the digest of the text. Roles other than
    those of the initials s, u and a can only be rerolled or deleted. A repeated row is a duplicate of the first. An
    empty table gives no rows; other columns, whatever their names, are not read. A text of any length is hashed where
    it is read and once more as it streams by.
    """
    made = damaged(rows, conv, turn, role, text)
    core = F.rtrim(F.col("text"), F.lit(_BLANK))
    plain = F.when(core == "", "blank").when(~F.right(core, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("none")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    texts = made.withColumn("digest", F.unhex(F.sha2("text", 256)))
    lines = texts.select("conv", "turn", "role", "digest", "gone", plain.alias("plain"), _initial().alias("initial"))
    nth = F.row_number().over(Window.partitionBy("conv", "gone", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    lines = lines.withColumn("nth", nth)
    fault = F.when(F.col("plain") == "blank", "blank").when(F.col("nth") > 1, "duplicate").otherwise(F.col("plain"))
    lines = lines.withColumn("fault", fault).repartition("conv").sortWithinPartitions("conv", *order, "nth")
    conv_type = rows.schema[conv].dataType
    edits_kind = T.StructType([T.StructField("conv", conv_type), T.StructField("part", T.IntegerType()), T.StructField("audit", T.StringType())])
    edits_kind = T.StructType(edits_kind.fields + [T.StructField(c, T.LongType()) for c in _COUNTS])
    out_kind = T.StructType([edits_kind["conv"], *edits_kind.fields[3:], edits_kind["audit"], T.StructField("sha", T.StringType())])
    edits_arrow, out_arrow = to_arrow_schema(edits_kind), to_arrow_schema(out_kind)
    seen = lines.select("conv", "turn", "gone", "initial", "fault")
    edits = seen.mapInArrow(lambda batches: _batches(_edits(_rows(batches)), edits_arrow), edits_kind)
    spoken = texts.filter("not gone").select("conv", "turn", "role", "digest", "text")
    both = edits.unionByName(spoken, allowMissingColumns=True)
    both = both.repartition("conv").sortWithinPartitions("conv", F.col("part").asc_nulls_last(), *order)
    found = both.drop("digest", "turn").mapInArrow(lambda batches: _batches(_digests(_rows(batches)), out_arrow), out_kind)
    return found.select(F.col("conv").alias(conv), *_COUNTS, "audit", F.col("sha").alias("repaired_sha256"))
