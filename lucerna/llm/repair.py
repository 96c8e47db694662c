"""Repair of conversation structure at least cost: a bidirectional search over tight arcs.

A conversation after repair has roles that begin ``(s?(ua)+)?``: an optional system turn, then pairs of user
and assistant.  Rows and the states of that pattern make a directed graph; an arc keeps, reroles or deletes a
row, or inserts an empty turn.  Minimum costs from the start (forward) and to the end (backward) tell every
arc that lies on some cheapest repair: its cost and both minima add up to the best.  From the start, a
frontier of states then takes the least letter that any tight arc offers, again and again; that gives the
ASCII-least audit without listing repairs.

Long conversations are cut.  Rows are sorted by ranges of (conversation, turn, ...), so a conversation of any
size is spread over ranges; runs of rows of one conversation become segments of at most ``SEGMENT`` codes, one
byte a row, with a four by four matrix of costs.  A scan over the segments of a conversation multiplies
matrices and gives each segment its forward and backward costs; a second one, over how each segment leads
from a state to a state, gives the state it starts in.  Everything else is done segment by segment, and rows
meet their edits by their place.  Only what the result states as one value (an audit, a hash over a whole
repaired conversation) is put together in one place, the hash as a stream.

Rows and edge cases: a null role or text is one space, a null turn or id is one space in the checksum; null
turns come first; rows of equal turn follow in the order of role and text (its first 64 characters, then its
hash); a null id is a conversation of its own; repeated rows are rows, the later ones duplicates; a role whose
first letter is none of s, u and a must be reroled or deleted; other columns are ignored; a conversation
without rows after damage gives zeros and an empty audit; an empty table gives nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lucerna.llm.common import slices, write_shared

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows of one segment, one byte each.
SEGMENT = 1 << 16
SPACE = " \t\n\v\f\r"
#: Classes of roles by their initial, faults, and the states of the pattern: start, after s, after u, after a.
CLASSES, FAULTS = ("", "s", "u", "a"), ("none", "truncated", "blank", "duplicate")
_NEXT = {(0, 1): 1, (0, 2): 2, (1, 2): 2, (2, 3): 3, (3, 2): 2}
_ACCEPT = (0, 3)
_ROLE = {2: "user", 3: "assistant"}
_LEGAL = {(1, 2), (2, 3), (3, 2)}
_FAR = 1 << 40


def _moves(code: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of all edits of a row: its code is 4 * fault + class."""
    fault, kind = divmod(code, 4)
    out = [("D", DELETE, state)]
    if fault < 2:
        extra = TRUNCATED if fault == 1 else 0
        if (state, kind) in _NEXT:
            out.append(("K", KEEP + extra, _NEXT[state, kind]))
        out += [("R", REROLE + extra, _NEXT[state, k]) for k in (2, 3) if (state, k) in _NEXT]
    return out


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least cost over what lies between: the product of two matrices of costs."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


MOVES = [[_moves(code, q) for q in range(4)] for code in range(16)]
INSERTS = [[_NEXT[q, k] for k in (2, 3) if (q, k) in _NEXT] for q in range(4)]


def _matrices() -> tuple[np.ndarray, list[np.ndarray]]:
    one = np.full((4, 4), _FAR, np.int64)
    np.fill_diagonal(one, 0)
    step = one.copy()
    for q in range(4):
        for to in INSERTS[q]:
            step[q, to] = INSERT
    inserts = _product(_product(step, step), step)
    rows = []
    for code in range(16):
        m = np.full((4, 4), _FAR, np.int64)
        for q in range(4):
            for _, cost, to in MOVES[code][q]:
                m[q, to] = min(m[q, to], cost)
        rows.append(m)
    return inserts, rows


_INSERTING, _ROWS = _matrices()
_STEPS = [_product(_INSERTING, m) for m in _ROWS]
#: Costs to the end behind the last row.
END = _product(_INSERTING, np.array([[0 if q in _ACCEPT else _FAR] for q in range(4)], np.int64))[:, 0].tolist()
START = [0, _FAR, _FAR, _FAR]
#: For each code, what leads to a state (forward) and where a state leads (backward), without the far ones.
_INTO = [[[(q, int(m[q, to])) for q in range(4) if m[q, to] < _FAR] for to in range(4)] for m in _ROWS]
_FROM = [[[(to, int(m[q, to])) for to in range(4) if m[q, to] < _FAR] for q in range(4)] for m in _STEPS]
_WIDER = [[(q, int(_INSERTING[q, to])) for q in range(4) if _INSERTING[q, to] < _FAR] for to in range(4)]


def _least(vector: list[int], arcs: list[list[tuple[int, int]]]) -> list[int]:
    return [min([vector[q] + cost for q, cost in of], default=_FAR) for of in arcs]


def segment_matrix(codes: bytes) -> np.ndarray:
    """Costs from each state before the rows to each state behind them; inserts behind them come later."""
    found = [_STEPS[c] for c in codes]
    while len(found) > 1:
        found = [_product(*found[i : i + 2]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
    return found[0]


def segment_edits(codes: bytes, forward: list[int], backward: list[int], best: int, start: int, last: bool) -> tuple[str, str, int]:
    """(letters, roles, end state): the least letters along tight arcs through one segment.

    ``roles`` has u or a for each letter that gives a turn that role, and - otherwise.
    """
    before, f = [], forward
    for c in codes:
        wide = _least(f, _WIDER)
        before.append(wide)
        f = _least(wide, _INTO[c])
    before.append(_least(f, _WIDER))
    behind = [backward]
    for c in reversed(codes):
        behind.append(_least(behind[-1], _FROM[c]))
    behind.reverse()
    letters, roles, frontier = [], [], {start}
    for i in range(len(codes) + last):
        while True:
            offers: dict[str, set[int]] = {}
            for q in frontier:
                base = before[i][q]
                for to in INSERTS[q]:
                    if base + INSERT + behind[i][to] == best:
                        offers.setdefault("I", set()).add(to)
                for letter, cost, to in MOVES[codes[i]][q] if i < len(codes) else ():
                    if base + cost + behind[i + 1][to] == best:
                        offers.setdefault(letter, set()).add(to)
            if not offers:
                break
            letter = min(offers)
            frontier = offers[letter]
            letters.append(letter)
            # Of one state every letter but a keep leads to one state, so a frontier agrees on the role.
            roles.append(CLASSES[min(frontier)] if letter in "IR" else "-")
            if letter != "I":
                break
    return "".join(letters), "".join(roles), min(frontier)


# Rows -------------------------------------------------------------------------


def damaged(turns: DataFrame) -> DataFrame:
    """Rows after the damage that the checksum of ``conv_id:turn`` deals to each."""
    t = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    t = t.withColumn("harm", F.crc32(key.cast("binary")) % 20).filter("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1)))
    return t.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _class() -> Column:
    initial = F.substring("role", 1, 1)
    return F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in the order of (conversation, turn, role, text) with their place ``at``, their class and own fault.

    A range may begin inside a conversation, a turn or a group of equal rows, so no key has to fit one task.
    """
    bare = F.rtrim("text", F.lit(SPACE))
    fault = F.when(bare == "", 2).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(1)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    keys = ["conv_id", "turn", F.substring("role", 1, 64), F.substring("text", 1, 64), F.xxhash64("role", "text"), "row"]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    said = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    return rows.select("conv_id", "turn", "role", "text", "at", _class().alias("class"), fault.alias("fault"), F.unhex(said).alias("said"))


def coded(rows: DataFrame) -> DataFrame:
    """conv_id, at and code of ordered rows; what an earlier row has said is a duplicate.

    The first of equal rows is found by partial aggregates; rows meet it by their place, which is unique.
    """
    first = rows.filter("fault <> 2").groupBy("conv_id", "said").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when((F.col("fault") < 2) & F.col("first").isNull(), 3).otherwise(F.col("fault"))
    return rows.select("conv_id", "at", "class", "fault").join(first, "at", "left").select("conv_id", "at", (4 * fault + F.col("class")).cast("int").alias("code"))


_SEGMENT = "conv_id long, at long, codes binary, matrix array<long>, blank long, duplicate long, truncated long, illegal long, first int, last int"


def segments(codes: DataFrame) -> DataFrame:
    """Runs of at most SEGMENT neighbouring rows of one conversation, with what they cost and count."""

    def packed(conv: int | None, at: int, raw: bytes) -> dict:
        kinds = [c % 4 for c in raw]
        faults = np.bincount(np.frombuffer(raw, np.uint8) // 4, minlength=4).tolist()
        illegal = sum(p not in _LEGAL for p in zip(kinds, kinds[1:], strict=False))
        return {
            "conv_id": conv, "at": at, "codes": raw, "matrix": segment_matrix(raw).ravel().tolist(), "blank": faults[2], "duplicate": faults[3],
            "truncated": faults[1], "illegal": illegal, "first": kinds[0], "last": kinds[-1],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("at", pa.int64()), ("codes", pa.binary()), ("matrix", pa.list_(pa.int64())), *((c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal")), ("first", pa.int32()), ("last", pa.int32())])
        conv, begin, raw = None, 0, bytearray()
        for b in batches:
            out = []
            for c, at, code in zip(b.column("conv_id").to_pylist(), b.column("at").to_pylist(), b.column("code").to_pylist(), strict=True):
                if raw and (c != conv or at != begin + len(raw) or len(raw) == SEGMENT):
                    out.append(packed(conv, begin, bytes(raw)))
                    raw.clear()
                if not raw:
                    conv, begin = c, at
                raw.append(code)
            yield pa.RecordBatch.from_pylist(out, schema)
        if raw:
            yield pa.RecordBatch.from_pylist([packed(conv, begin, bytes(raw))], schema)

    return codes.repartitionByRange("at").sortWithinPartitions("at").mapInArrow(run, _SEGMENT)


def _scan(rows: DataFrame, each: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``each`` over the rows of a conversation in order; rows are segments without their codes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        kind = pa.schema([(n, {"long": pa.int64(), "boolean": pa.bool_()}.get(t, pa.list_(pa.int64()))) for n, t in (x.strip().split(" ") for x in schema.split(","))])
        for b in slices(batches):
            out = []
            for row in b.to_pylist():
                if held and held[-1]["conv_id"] != row["conv_id"]:
                    out += each(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, kind)
        if held:
            yield pa.RecordBatch.from_pylist(each(held), kind)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(run, schema)


def _both_ways(found: list[dict]) -> list[dict]:
    """Forward costs before and backward costs behind each segment of a conversation, and the best of all."""
    matrices = [np.array(x["matrix"], np.int64).reshape(4, 4) for x in found]
    forward, backward = [START], [END]
    for m in matrices[:-1]:
        forward.append(_product(np.array([forward[-1]], np.int64), m)[0].tolist())
    for m in reversed(matrices):
        backward.append(_product(m, np.array(backward[-1], np.int64)[:, None])[:, 0].tolist())
    best = backward[-1][0]
    between = sum((a["last"], b["first"]) not in _LEGAL for a, b in zip(found, found[1:], strict=False))
    tail = len(found) - 1
    return [
        {"conv_id": x["conv_id"], "at": x["at"], "forward": f, "backward": b, "best": best, "between": between if i == 0 else 0, "head": i == 0, "tail": i == tail}
        for i, (x, f, b) in enumerate(zip(found, forward, reversed(backward[:-1]), strict=True))
    ]


def _states(found: list[dict]) -> list[dict]:
    """The state in which each segment of a conversation starts, from where each leads."""
    out, state = [], 0
    for x in found:
        out.append({"at": x["at"], "start": state})
        state = x["ends"][state]
    return out


def _traverse(row: dict, start: int) -> tuple[str, str, int]:
    return segment_edits(row["codes"], row["forward"], row["backward"], row["best"], start, row["tail"])


def _leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = b.to_pylist()
        # A state that no cheapest repair passes offers nothing and leads nowhere that matters.
        ends = [[_traverse(r, q)[2] for q in range(4)] for r in rows]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("at"), pa.array(ends, pa.list_(pa.int64()))], ["conv_id", "at", "ends"])


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        found = [_traverse(r, r["start"] or 0) for r in b.to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), b.column("at"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())], ["conv_id", "at", "letters", "roles"])


def _row_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each row of a segment: the turns inserted before it, its own letter and role, those behind."""
    for b in slices(batches):
        for at, letters, roles in zip(b.column("at").to_pylist(), b.column("letters").to_pylist(), b.column("roles").to_pylist(), strict=True):
            before, own, given, pending = [], [], [], []
            for letter, role in zip(letters, roles, strict=True):
                name = _ROLE[CLASSES.index(role)] if role != "-" else None
                if letter == "I":
                    pending.append(name)
                else:
                    before.append(pending)
                    own.append(letter)
                    given.append(name)
                    pending = []
            behind = [[]] * (len(own) - 1) + [pending]
            names = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(own)), pa.int64()), pa.array(before, names), pa.array(own, pa.string()), pa.array(given, pa.string()), pa.array(behind, names)], ["at", "before", "letter", "given", "behind"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ordered rows, audits, repaired turns) of conversations as they are.

    Audits: conv_id, blank, duplicate, truncated, illegal, cost and audit.  Repaired turns: conv_id, at and
    place (their order), role and text.
    """
    placed, _ = write_shared(ordered(rows), "repair-rows")
    parts, _ = write_shared(segments(coded(placed)), "repair-segments")
    costs, _ = write_shared(_scan(parts.drop("codes"), _both_ways, "conv_id long, at long, forward array<long>, backward array<long>, best long, between long, head boolean, tail boolean"), "repair-costs")
    known = parts.select("conv_id", "at", "codes").join(costs.drop("conv_id"), "at")
    leads = known.filter("NOT (head AND tail)").mapInArrow(_leads, "conv_id long, at long, ends array<long>")
    starts = _scan(leads, _states, "at long, start long")
    letters, _ = write_shared(known.join(starts, "at", "left").mapInArrow(_letters, "conv_id long, at long, letters string, roles string"), "repair-letters")
    counts = parts.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")), F.lit(None).cast("long").alias("cost"), F.lit(None).cast("string").alias("audit"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")]
    joints = costs.groupBy("conv_id").agg(*zero, F.sum("between").alias("illegal"), F.max("best").alias("cost"), F.lit(None).cast("string").alias("audit"))
    spelt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "letters"))), lambda x: x["letters"]), "")
    audits = letters.groupBy("conv_id").agg(*zero, F.lit(0).cast("long").alias("illegal"), F.lit(None).cast("long").alias("cost"), spelt.alias("audit"))
    audits = counts.unionByName(joints).unionByName(audits).groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")), F.max("cost").alias("cost"), F.max("audit").alias("audit"))
    edits = letters.mapInArrow(_row_edits, "at long, before array<string>, letter string, given string, behind array<string>")
    added = lambda names: F.transform(names, lambda n: F.struct(n.alias("role"), F.lit("").alias("text")))
    own = F.when(F.col("letter") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(F.coalesce("given", "role").alias("role"), F.col("text").alias("text"))))
    turns = placed.select("conv_id", "at", "role", "text").join(edits, "at")
    turns = turns.select("conv_id", "at", F.posexplode(F.concat(added("before"), own, added("behind"))).alias("place", "x"))
    return placed, audits, turns.select("conv_id", "at", "place", "x.role", "x.text")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each conversation, fed row by row: no conversation is held."""
    names = ["conv_id", "repaired_sha256"]
    kinds = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    conv, running = None, None
    for b in slices(batches):
        out = []
        for c, role, text in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True):
            if running is not None and c != conv:
                out.append(dict(zip(names, (conv, running.hexdigest()), strict=True)))
                running = None
            if running is None:
                conv, running = c, hashlib.sha256()
            else:
                running.update(b"\n")
            running.update(f"{role}:{text}".encode())
        yield pa.RecordBatch.from_pylist(out, kinds)
    if running is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (conv, running.hexdigest()), strict=True))], kinds)


def repair_report(turns: DataFrame) -> DataFrame:
    """Damage, repair and digests of every conversation of ``turns``."""
    placed, audits, repaired = repair(damaged(turns))
    distinct = placed.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.lit(1).alias("one"))
    gaps = distinct.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    hashes = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "at", "place").mapInArrow(_hashes, "conv_id long, repaired_sha256 string")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id"))
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    # One row for each conversation from each side; a null id is a group like any other.
    for side in (gaps, audits, hashes):
        every = every.unionByName(side, allowMissingColumns=True)
    out = every.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in [*numbers, "audit", "repaired_sha256"]))
    return out.select(
        "conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
