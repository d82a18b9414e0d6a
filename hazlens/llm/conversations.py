"""Conversations damaged in known ways, audited and repaired by the cheapest edits.

Faults of single rows are native expressions and counts: equal rows are counted
first, and a row is a duplicate when an earlier turn of its conversation has its role and
text. What is left of a row is two letters, its role's initial and its fault.

The cheapest edits are a shortest path over (rows consumed, state of the pattern).
Forward and backward minimum costs show which arcs lie on a shortest path; these tight
arcs are a graph without cycles, through which a set of states is led, taking the least
edit letter at each step. The letters fix everything else: the number of rows that come
out is odd if a system row leads them, and user and assistant alternate.

A conversation of over ``whole`` rows or bytes is cut into segments that Spark deals by
ranges of its order. A segment is a 4 x 4 matrix of minimum costs, so the costs at all
segment ends follow from products of small matrices; then each segment tells where
each of the 15 sets of states would come out, and at last each writes its own edits. Only the
digest of the repaired text is taken by one task a conversation, as SHA-256 is sequential, and
that task reads one segment at a time.

Defined results: null fields of a row read as one space (in the key of the damage as well),
but a turn that is null sorts first and a null conv_id names a conversation; rows
of one turn are ordered by role and text; an initial other than s, u and a, or none, fits no
pattern and makes its pairs illegal; repeated rows are rows; a conversation that lost all
rows has zeros, no audit and the digest of nothing; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazlens.llm import runs, scratch

SPACES = " \t\n\x0b\x0c\r"
#: Rows, and bytes of text, up to which a conversation is worked on whole; and rows of a segment beyond.
WHOLE, SEGMENT = 20_000, 4_096
WHOLE_BYTES, SEGMENT_BYTES = 16 << 20, 4 << 20

DROPPED, EMPTIED, UNSTOPPED, REPEATED, USURPED = range(5)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and times of the rows after damage by the CRC-32 of ``conv_id:turn``."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    keyed = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), kind.alias("kind")).where(F.col("kind") != DROPPED)
    text = F.when(F.col("kind") == EMPTIED, "").when(F.col("kind") == UNSTOPPED, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == USURPED, "user").otherwise(F.col("role"))
    return keyed.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == REPEATED, 2).otherwise(1).cast("long").alias("times"))


#: The total order of a conversation's rows; ascending, nulls come first.
ORDER = ["turn", "role", "text"]


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times, initial and fault of distinct damaged rows: blank (b), duplicate (d), truncated (t) or none (k).

    Of ``times`` equal rows the fault is the first one's; the others are duplicates, or blank too.
    """
    same = scratch.written(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("times").alias("times")), "turns")
    seen = F.struct(F.col("turn").isNotNull().alias("dated"), "turn")
    key = F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)
    first = same.select("conv_id", key.alias("key"), seen.alias("seen")).groupBy("conv_id", "key").agg(F.min("seen").alias("first"), F.count("*").alias("n")).where("n > 1")
    # the few that recur; written, so that a row said in very many turns can be split in the join
    first = scratch.written(first.select(F.col("conv_id").alias("__conv"), F.col("key").alias("__key"), "first"), "said")
    met = same.withColumn("key", key).join(first, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("key") == F.col("__key")), "left")
    shown = F.rtrim("text", F.lit(SPACES))
    fault = F.when(F.trim("text", F.lit(SPACES)) == "", "b").when(F.col("first").isNotNull() & (F.col("first") != seen), "d").when(~F.substring(shown, -1, 1).isin(".", "!", "?"), "t").otherwise("k")
    initial = F.substring("role", 1, 1)
    return met.select("conv_id", "turn", "role", "text", "times", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"), fault.alias("fault"))


# ---- the automaton ------------------------------------------------------------------
# States: nothing yet, after the system row, after a user, after an assistant.

FAR = 1 << 60
START, END = (0, FAR, FAR, FAR), (0, FAR, FAR, 0)
#: Where a row of a role leads; and where the user or assistant row leads that a state waits for.
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "x": {}}
NEXT = (2, 2, 3, 2)
LEGAL = {"su", "ua", "au"}


@functools.cache
def arcs(initial: str, fault: str) -> tuple[tuple[str, int, int, int], ...]:
    """(letter, from, to, cost) of all edits that consume a row."""
    out = [("D", s, s, 3) for s in range(4)]
    if fault not in "bd":
        more = int(fault == "t")
        out += [("K", s, t, more) for s, t in KEPT[initial].items()]
        out += [("R", s, t, 2 + more) for s, t in enumerate(NEXT)]
    return tuple(out)


INSERT = tuple(("I", s, t, 2) for s, t in enumerate(NEXT))


def _closed(costs: list[int], back: bool = False) -> tuple[int, ...]:
    """Costs with insertions; two in a row are all that can help."""
    costs = list(costs)
    for _ in range(2):
        for _, s, t, c in INSERT:
            a, b = (t, s) if back else (s, t)
            costs[b] = min(costs[b], costs[a] + c)
    return tuple(costs)


def forward(initials: str, marks: str, start: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The least cost to each state, before each row and after the last."""
    out = [_closed(start)]
    for i, f in zip(initials, marks, strict=True):
        costs, now = [FAR] * 4, out[-1]
        for _, s, t, c in arcs(i, f):
            costs[t] = min(costs[t], now[s] + c)
        out.append(_closed(costs))
    return out


def backward(initials: str, marks: str, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The least cost from each state to the end, before each row and after the last."""
    out = [_closed(end, back=True)]
    for i, f in zip(reversed(initials), reversed(marks), strict=True):
        costs, now = [FAR] * 4, out[-1]
        for _, s, t, c in arcs(i, f):
            costs[s] = min(costs[s], now[t] + c)
        out.append(_closed(costs, back=True))
    return out[::-1]


def led(initials: str, marks: str, ahead: list[tuple[int, ...]], behind: list[tuple[int, ...]], states: frozenset[int], last: bool) -> tuple[str, frozenset[int]]:
    """The least letters along tight arcs from a set of states, and the states they lead to.

    Stops after the last row; insertions behind it belong to what follows, unless this is the ``last`` of all.
    """
    best, at, n, letters = min(map(sum, zip(ahead[0], behind[0], strict=True))), 0, len(initials), []
    while True:
        if at == n and (not last or any(s in (0, 3) and ahead[n][s] + END[s] == best for s in states)):
            return "".join(letters), states
        found: dict[str, set[int]] = {}
        for letter, s, t, c in INSERT if at == n else (*arcs(initials[at], marks[at]), *INSERT):
            if s in states and ahead[at][s] + c + behind[at + (letter != "I")][t] == best:
                found.setdefault(letter, set()).add(t)
        letter = min(found)
        letters.append(letter)
        states, at = frozenset(found[letter]), at + (letter != "I")


@functools.lru_cache(maxsize=1 << 16)
def repaired(initials: str, marks: str) -> tuple[int, str]:
    """The cost and the letters of the cheapest edits of a whole conversation."""
    ahead, behind = forward(initials, marks, START), backward(initials, marks, END)
    return behind[0][0], led(initials, marks, ahead, behind, frozenset([0]), True)[0]


def illegal(initials: str) -> int:
    return sum(initials[k : k + 2] not in LEGAL for k in range(len(initials) - 1))


def written_out(letters: str, roles: list[str], texts: list[str], out: int, odd: bool) -> Iterator[str]:
    """The repaired rows of these letters. out: rows that came out before; odd: whether all that come out lead with a system row."""
    row = 0
    for letter in letters:
        if letter == "I" or letter == "R":
            role = ("assistant" if odd else "user") if out % 2 == 0 else ("user" if odd else "assistant")
        elif letter == "K":
            role = roles[row]
        if letter != "D":
            yield f"{role}:{texts[row] if letter != 'I' else ''}"
            out += 1
        row += letter != "I"


# ---- whole conversations ----------------------------------------------------------------

REPAIRED = "conv_id long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = ["conv_id", "turn", "role", "text", "times", "initial", "fault"]


def _unfolded(times: np.ndarray, initials: list[str], marks: list[str], roles: list[str], texts: list[str]) -> tuple[str, str, list[str], list[str]]:
    """Rows each by itself: of equal ones those after the first are blank as it is, or duplicates."""
    if (times == 1).all():
        return "".join(initials), "".join(marks), roles, texts
    n = times.tolist()
    later = ["b" if f == "b" else "d" for f in marks]
    return (
        "".join(i * k for i, k in zip(initials, n, strict=True)),
        "".join(f + x * (k - 1) for f, x, k in zip(marks, later, n, strict=True)),
        [r for r, k in zip(roles, n, strict=True) for _ in range(k)],
        [t for t, k in zip(texts, n, strict=True) for _ in range(k)],
    )


def _one(conv, times, initials, marks, roles, texts) -> tuple:
    initials, marks, roles, texts = _unfolded(np.array(times), initials, marks, roles, texts)
    cost, letters = repaired(initials, marks)
    came = len(letters) - letters.count("D")
    text = "\n".join(written_out(letters, roles, texts, 0, came % 2 == 1))
    return conv, illegal(initials), cost, letters, hashlib.sha256(text.encode()).hexdigest()


def _wholly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations whose rows follow each other in order."""
    names = ["conv_id", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
    now, held = None, None
    for batch in batches:
        done = []
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "times", "initial", "fault", "role", "text")]
        ids = columns[0]
        cuts = [k for k in range(len(ids)) if k == 0 or ids[k] != ids[k - 1]] + [len(ids)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = [c[a:b] for c in columns[1:]]
            if held is not None and ids[a] == now:
                held = [x + y for x, y in zip(held, part, strict=True)]
                continue
            if held is not None:
                done.append(_one(now, *held))
            now, held = ids[a], part
        if done:
            yield table(done)
    if held is not None:
        yield table([_one(now, *held)])


# ---- segments of long conversations -------------------------------------------------------

PIECES = "conv_id long, part int, seg long, initials string, marks string, roles array<string>, texts array<string>"


def _segments(rows_each: int, bytes_each: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seg = TaskContext.get().partitionId(), 0
        now, held, size = None, ([], [], [], []), 0

        def cut() -> pa.RecordBatch:
            nonlocal held, size, seg
            i, f, r, t = held
            columns = [[now], [part], [seg], ["".join(i)], ["".join(f)], [r], [t]]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
            held, size, seg = ([], [], [], []), 0, seg + 1
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "part", "seg", "initials", "marks", "roles", "texts"])

        for batch in batches:
            for conv, times, i, f, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "times", "initial", "fault", "role", "text")), strict=True):
                if held[0] and conv != now:
                    yield cut()
                now = conv
                for k in range(times):
                    for column, x in zip(held, (i, f if k == 0 or f == "b" else "d", role, text), strict=True):
                        column.append(x)
                    size += len(text)
                    if len(held[0]) >= rows_each or size >= bytes_each:
                        yield cut()
        if held[0]:
            yield cut()

    return work


def _matrix(pdf: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each segment's least costs from each state before it to each after it."""
    for d in pdf:
        m = [[x for s in range(4) for x in forward(i, f, tuple(0 if t == s else FAR for t in range(4)))[-1]] for i, f in zip(d["initials"], d["marks"], strict=True)]
        ends = [i[0] + i[-1] for i in d["initials"]]
        yield pd.DataFrame({"conv_id": d["conv_id"].astype("Int64"), "part": d["part"], "seg": d["seg"], "m": m, "ends": ends, "illegal": [illegal(i) for i in d["initials"]]})


def _costs(d: pd.DataFrame) -> pd.DataFrame:
    """Costs before and behind each segment of one conversation; one small row a segment."""
    d = d.sort_values(["part", "seg"], ignore_index=True)
    ms = [np.array(m, dtype=object).reshape(4, 4) for m in d["m"]]
    ahead, behind = [_closed(START)], [_closed(END, back=True)]
    for m in ms:
        ahead.append(tuple(int(min(FAR, x)) for x in (np.array(ahead[-1], dtype=object)[:, None] + m).min(0)))
    for m in reversed(ms):
        behind.append(tuple(int(min(FAR, x)) for x in (m + np.array(behind[-1], dtype=object)[None]).min(1)))
    behind = behind[::-1]
    ends = d["ends"].tolist()
    pairs = [int(x[-1] + y[0] not in LEGAL) for x, y in zip(ends, ends[1:], strict=False)]
    return pd.DataFrame({
        "conv_id": d["conv_id"].astype("Int64"), "part": d["part"], "seg": d["seg"], "ahead": [list(a) for a in ahead[:-1]], "behind": [list(b) for b in behind[1:]],
        "last": [k == len(d) - 1 for k in range(len(d))], "cost": behind[0][0], "illegal": [int(n) + p for n, p in zip(d["illegal"], [*pairs, 0], strict=True)],
    })


def _set(bits: int) -> frozenset[int]:
    return frozenset(s for s in range(4) if bits >> s & 1)


def _through(initials: str, marks: str, ahead, behind, bits: int, last: bool) -> tuple[str, int]:
    front, back = forward(initials, marks, tuple(ahead)), backward(initials, marks, tuple(behind))
    letters, states = led(initials, marks, front, back, _set(bits), last)
    return letters, sum(1 << s for s in states)


def _fronts(pdf: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each set of states on shortest paths before a segment: the set behind it, and the rows that come out."""
    for d in pdf:
        to, came = [], []
        for i, f, a, b, last in zip(d["initials"], d["marks"], d["ahead"], d["behind"], d["last"], strict=True):
            front, back = forward(i, f, tuple(a)), backward(i, f, tuple(b))
            best = min(map(sum, zip(front[0], back[0], strict=True)))
            tight = {s for s in range(4) if front[0][s] + back[0][s] == best}
            own, out = [0] * 16, [0] * 16
            for bits in range(1, 16):
                if _set(bits) <= tight:
                    letters, states = led(i, f, front, back, _set(bits), last)
                    own[bits], out[bits] = sum(1 << s for s in states), len(letters) - letters.count("D")
            to.append(own)
            came.append(out)
        yield pd.DataFrame({"conv_id": d["conv_id"].astype("Int64"), "part": d["part"], "seg": d["seg"], "to": to, "came": came})


def _entered(d: pd.DataFrame) -> pd.DataFrame:
    """The set of states before each segment of one conversation, and the rows that came out before it and in all."""
    d = d.sort_values(["part", "seg"], ignore_index=True)
    bits, out, sets, before = 1, 0, [], []
    for to, came in zip(d["to"], d["came"], strict=True):
        sets.append(bits)
        before.append(out)
        bits, out = int(to[bits]), out + int(came[bits])
    return pd.DataFrame({"conv_id": d["conv_id"].astype("Int64"), "part": d["part"], "seg": d["seg"], "bits": sets, "out": before, "odd": out % 2 == 1})


def _edited(pdf: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each segment's letters, and its repaired rows as one text (null for none)."""
    for d in pdf:
        letters, text = [], []
        for i, f, a, b, last, bits, out, odd, roles, texts in zip(*(d[c] for c in ("initials", "marks", "ahead", "behind", "last", "bits", "out", "odd", "roles", "texts")), strict=True):
            letters.append(_through(i, f, a, b, int(bits), last)[0])
            rows = list(written_out(letters[-1], list(roles), list(texts), int(out), bool(odd)))
            text.append("\n".join(rows) if rows else None)
        yield pd.DataFrame({"conv_id": d["conv_id"].astype("Int64"), "part": d["part"], "seg": d["seg"], "cost": d["cost"], "illegal": d["illegal"], "letters": letters, "piece": text})


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations whose segments follow each other in order, one at a time."""
    now, state = None, None

    def told() -> pa.RecordBatch:
        digest, letters, pairs, cost, _ = state
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([pairs], pa.int64()), pa.array([cost], pa.int64()), pa.array(["".join(letters)]), pa.array([digest.hexdigest()])], ["conv_id", "illegal", "cost", "audit", "repaired_sha256"])

    for batch in batches:
        for conv, cost, pairs, letters, piece in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "cost", "illegal", "letters", "piece")), strict=True):
            if state is not None and conv != now:
                yield told()
                state = None
            if state is None:
                now, state = conv, [hashlib.sha256(), [], 0, cost, False]
            state[1].append(letters)
            state[2] += pairs
            if piece is not None:
                state[0].update((("\n" if state[4] else "") + piece).encode())
                state[4] = True
    if state is not None:
        yield told()


AT = ["conv_id", "part", "seg"]


def _on(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with what ``right`` has of the same segment; a null conv_id is one."""
    right = right.withColumnsRenamed({c: f"__{c}" for c in AT})
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("__conv_id")) & (F.col("part") == F.col("__part")) & (F.col("seg") == F.col("__seg"))).drop(*(f"__{c}" for c in AT))


def _in_segments(rows: DataFrame, segment: int) -> DataFrame:
    order = ["conv_id", *ORDER]
    # bounds of ranges are sampled, so what they dealt is written before it is used
    cut = scratch.written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "times", "initial", "fault", "role", "text").mapInArrow(_segments(segment, SEGMENT_BYTES), PIECES), "segments")
    marks = cut.select(*AT, "initials", "marks")
    matrices = marks.mapInPandas(_matrix, "conv_id long, part int, seg long, m array<long>, ends string, illegal long")
    costs = scratch.written(matrices.groupBy("conv_id").applyInPandas(_costs, "conv_id long, part int, seg long, ahead array<long>, behind array<long>, last boolean, cost long, illegal long"), "costs")
    fronts = _on(marks, costs.drop("cost", "illegal")).mapInPandas(_fronts, "conv_id long, part int, seg long, to array<int>, came array<long>")
    entered = scratch.written(fronts.groupBy("conv_id").applyInPandas(_entered, "conv_id long, part int, seg long, bits int, out long, odd boolean"), "entered")
    edits = scratch.written(_on(_on(cut, costs), entered).mapInPandas(_edited, "conv_id long, part int, seg long, cost long, illegal long, letters string, piece string"), "edits")
    return runs.mapped(edits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg"), _digested, REPAIRED)


def audited(conversations: DataFrame, whole: int = WHOLE, segment: int = SEGMENT, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    judged = scratch.written(faults(damaged(rows)), "judged")
    is_blank, is_later = F.col("fault") == "b", F.col("fault") == "d"
    turns = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    tally = judged.groupBy("conv_id").agg(
        F.coalesce(turns, F.lit(0)).alias("gaps"),
        F.sum(F.when(is_blank, F.col("times")).otherwise(0)).alias("blank"),
        F.sum(F.when(is_blank, 0).when(is_later, F.col("times")).otherwise(F.col("times") - 1)).alias("duplicate"),
        F.count_if(F.col("fault") == "t").alias("truncated"),
        F.sum("times").alias("rows"),
        F.sum(F.col("times") * F.octet_length("text")).alias("bytes"),
    )
    tally = scratch.written(tally, "tally")
    long = (F.col("rows") > whole) | (F.col("bytes") > whole_bytes)
    large = tally.where(long).select(F.col("conv_id").alias("__conv"))
    same = F.col("conv_id").eqNullSafe(F.col("__conv"))
    short = judged.join(large, same, "left_anti").select(*ROWS)
    done = runs.mapped(short.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER).select("conv_id", "times", "initial", "fault", "role", "text"), _wholly, REPAIRED)
    if not large.isEmpty():
        done = done.unionByName(_in_segments(judged.join(large, same, "left_semi").select(*ROWS), segment))
    done = done.withColumnRenamed("conv_id", "__done")
    told = tally.join(done, F.col("conv_id").eqNullSafe(F.col("__done"))).select(F.col("conv_id").alias("__told"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    nothing = hashlib.sha256(b"").hexdigest()
    every = rows.select("conv_id").distinct().join(told, F.col("conv_id").eqNullSafe(F.col("__told")), "left")
    return every.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _sql_step(state: int) -> str:
    """Least cost and letters of a state after a row, from the states before it, as one string that sorts by both."""
    arc = lambda frm, cost, letter, when: f"CASE WHEN {when} AND s{frm} IS NOT NULL THEN lpad((left(s{frm}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr(s{frm}, 10) || '{letter}' END"
    options = [arc(state, 3, "D", "true")]
    for frm, to in [(0, 2), (1, 2), (2, 3), (3, 2)]:
        if to == state:
            options += [arc(frm, "(r.fault = 't')::INT", "K", f"r.fault IN ('k', 't') AND r.initial = '{'u' if to == 2 else 'a'}'"), arc(frm, "2 + (r.fault = 't')::INT", "R", "r.fault IN ('k', 't')")]
    if state == 1:
        options.append(arc(0, "(r.fault = 't')::INT", "K", "r.fault IN ('k', 't') AND r.initial = 's'"))
    return f"least({', '.join(options)}, NULL)" if len(options) == 1 else f"least({', '.join(options)})"


def _sql_insert(a: str, b: str, c: str, d: str) -> tuple[str, str, str, str]:
    put = lambda x: f"lpad((left({x}, 9)::BIGINT + 2)::VARCHAR, 9, '0') || substr({x}, 10) || 'I'"
    return a, b, f"least({c}, {put(a)}, {put(b)}, {put(d)})", f"least({d}, {put(c)})"


SQL = f"""
    WITH RECURSIVE keyed AS (
        SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
               encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k
        FROM conversations
    ), crc AS (
        SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, octet_length(k) + 1), lambda i: [('0x' || hex(k)[2 * i - 1:2 * i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 20 AS kind
        FROM keyed
    ), hurt AS (
        SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
               unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM crc WHERE kind <> 0
    ), numbered AS (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM hurt
    ), judged AS (
        SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial,
               CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
                    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                    WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 't' ELSE 'k' END AS fault
        FROM numbered
    ), counted AS (
        SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
               count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) AS n
        FROM judged GROUP BY conv_id
    ), pairs AS (
        SELECT conv_id, count(*) FILTER (initial || after NOT IN ('su', 'ua', 'au')) AS illegal
        FROM (SELECT conv_id, initial, lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS after FROM judged) GROUP BY conv_id
    ), walk AS (
        SELECT conv_id, 0::BIGINT AS i, '000000000' AS s0, NULL::VARCHAR AS s1, '000000002I' AS s2, '000000004II' AS s3 FROM counted
        UNION ALL
        SELECT conv_id, i, s0, s1, {_sql_insert("s0", "s1", "s2", "s3")[2]} AS s2, {_sql_insert("s0", "s1", "s2", "s3")[3]} AS s3 FROM (
            SELECT conv_id, i, s0, s1, {_sql_insert("s0", "s1", "s2", "s3")[2]} AS s2, {_sql_insert("s0", "s1", "s2", "s3")[3]} AS s3 FROM (
                SELECT r.conv_id, r.i, {_sql_step(0)} AS s0, {_sql_step(1)} AS s1, {_sql_step(2)} AS s2, {_sql_step(3)} AS s3
                FROM walk w JOIN judged r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
            )
        )
    ), ended AS (
        SELECT w.conv_id, least(s0, s3) AS best FROM walk w JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n
    ), edits AS (
        SELECT conv_id, left(best, 9)::BIGINT AS cost, substr(best, 10) AS audit FROM ended
    ), letters AS (
        SELECT conv_id, p, letter, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS o,
               count(*) FILTER (letter <> 'D') OVER (PARTITION BY conv_id) AS came
        FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, unnest(string_split(audit, '')) AS letter FROM edits)
        WINDOW w AS (PARTITION BY conv_id ORDER BY p)
    ), texts AS (
        SELECT l.conv_id, string_agg(CASE WHEN letter = 'K' THEN r.role WHEN (o - came % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END
               || ':' || CASE WHEN letter = 'I' THEN '' ELSE r.text END, chr(10) ORDER BY p) AS t
        FROM letters l LEFT JOIN judged r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND letter <> 'I'
        WHERE letter <> 'D' GROUP BY l.conv_id
    )
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN pairs ON pairs.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN edits ON edits.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM c.conv_id
"""
