"""Operator 12, conversation structure repair by a checkpointed dynamic
programme.

A conversation's rows are kept, reroled, deleted or joined by inserted ones so
that the initials of its roles read ``(s?(ua)+)?``, at least cost.  The state of
the programme is what was emitted last: nothing, s, u or a.  Going backward, a
vector holds each state's cost of the rest; going forward, the ASCII-least edit
among the tight ones is taken.  Backward vectors are stored only at checkpoints,
about the square root of the rows apart, and blocks between them are computed
again while walking forward.

A conversation may hold a third of all rows: rows are sorted by range and cut
in chunks of CHUNK, of one byte each.  What lies inside a chunk is solved
there.  A piece that touches a chunk's border gives its cost matrix (4 x 4);
these are multiplied along the conversation, which gives the vectors at the
borders (checkpoints again), then each piece says where its walk ends for each
state, and then it is walked from its own.

Rows of a conversation go by turn (nulls first), then role, the text's first
HEAD characters and its hash.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import cut_lineage
from .frames import read_table, take_columns

#: Rows of a chunk are 2 ** CHUNK_BITS at most.
CHUNK_BITS = 16
HEAD = 40
BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States, also initials of roles (OTHER: none that a repaired one has).
NONE, S, U, A = range(4)
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
AFTER = (U, U, A, U)
ROLE = {U: "user", A: "assistant"}
#: Bits of a row's code above its initial.
CUT, EMPTY, COPY = 4, 8, 16
FAR = 1 << 40
#: Costs at the end: of inserting what is missing.
END = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, int, int, int]


def closed(v) -> Vector:
    """With rows inserted at this place where that is cheaper."""
    e, s, u, a = v
    u, a = min(u, a + INSERT), min(a, u + INSERT)
    return (min(e, u + INSERT, FAR), min(s, u + INSERT, FAR), min(u, FAR), min(a, FAR))


def kept(code: int, state: int) -> int | None:
    """The state after the row is kept, None where it cannot be."""
    initial = code & 3
    if code >= EMPTY or initial == OTHER:
        return None
    return initial + 1 if (initial == 0 and state == NONE) or (
        initial > 0 and AFTER[state] == initial + 1) else None


@lru_cache(1 << 16)
def before(code: int, after: Vector) -> tuple[int, Vector]:
    """(least, vector less its least) before a row, from the vector after it."""
    extra = TRUNCATED if code & CUT else 0
    out = []
    for state in range(4):
        cost = after[state] + DELETE
        if code < EMPTY:
            cost = min(cost, after[AFTER[state]] + REROLE + extra)
            if (to := kept(code, state)) is not None:
                cost = min(cost, after[to] + extra)
        out.append(cost)
    v = closed(out)
    least = min(v)
    return least, tuple(x if x >= FAR else x - least for x in v)


@lru_cache(1 << 16)
def moves(code: int, after: Vector, state: int) -> tuple[str, int]:
    """The ASCII-least tight edits up to and with a row, and the state then."""
    least, now = before(code, after)
    now = [x if x >= FAR else x + least for x in now]
    extra, said = TRUNCATED if code & CUT else 0, ""
    while True:
        if now[state] == after[state] + DELETE:
            return said + "D", state
        if now[state] == now[AFTER[state]] + INSERT:
            said, state = said + "I", AFTER[state]
            continue
        to = kept(code, state)
        if to is not None and now[state] == after[to] + extra:
            return said + "K", to
        return said + "R", AFTER[state]


def backward(codes: bytes, end: Vector, apart: int = 0):
    """(cost above the vector's least, vector at the start, vectors stored at
    every ``apart``-th row)."""
    total, v, stored = 0, end, {len(codes): end}
    for i in range(len(codes) - 1, -1, -1):
        least, v = before(codes[i], v)
        total += least
        if apart and i % apart == 0:
            stored[i] = v
    return total, v, stored


def walk(codes: bytes, end: Vector, state: int) -> tuple[str, int]:
    """The edits of the rows from ``state`` on, and the state after them."""
    apart = isqrt(len(codes)) + 1
    _, _, stored = backward(codes, end, apart)
    said = []
    for at in range(0, len(codes), apart):
        to = min(at + apart, len(codes))
        block = [stored[to]]  # the vectors after each row, the last first
        for i in range(to - 1, at, -1):
            block.append(before(codes[i], block[-1])[1])
        for i in range(at, to):
            edits, state = moves(codes[i], block[to - 1 - i], state)
            said.append(edits)
    return "".join(said), state


def closing(state: int) -> str:
    """The inserts after the last row."""
    return "I" * (END[state] // INSERT)


def matrix(codes: bytes) -> list[int]:
    """Costs from each state before the rows to each state after them."""
    out = np.full((4, 4), FAR, np.int64)
    for to in range(4):
        end = [FAR] * 4
        end[to] = 0
        total, v, _ = backward(codes, tuple(end))
        out[:, to] = [min(FAR, x + total) if x < FAR else FAR for x in v]
    return out.ravel().tolist()


LEGAL = {(0, 1), (1, 2), (2, 1)}
_legal = np.array([[(a, b) in LEGAL for b in range(4)] for a in range(4)])

PIECE = T.StructType([
    T.StructField("start", T.LongType()), T.StructField("inside", T.BooleanType()),
    T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType()),
    T.StructField("blank", T.LongType()), T.StructField("duplicate", T.LongType()),
    T.StructField("truncated", T.LongType()), T.StructField("illegal", T.LongType()),
    T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
    T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("codes", T.BinaryType())])


def _solve_chunk(table: pa.Table) -> pa.Table:
    """The pieces of conversations in one chunk, solved where whole."""
    pos, code = table["pos"].to_numpy(), table["code"].to_numpy()
    mark = code == COPY  # not a row: the first of equal rows is at this place
    rows = np.flatnonzero(~mark)
    rows = rows[np.argsort(pos[rows])]
    codes = code[rows].astype(np.uint8)
    copy = (codes < EMPTY) & ~np.isin(pos[rows], pos[mark])
    codes[copy] |= COPY
    who = table["conv_id"].combine_chunks().take(pa.array(rows))
    same = who.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    ends = np.concatenate([starts[1:], [len(rows)]])
    cut = ((codes & CUT) > 0) & (codes < EMPTY)
    bad = np.zeros(len(rows), bool)
    bad[1:] = ~_legal[codes[:-1] & 3, codes[1:] & 3]
    bad[starts] = False
    counts = [np.add.reduceat(x.astype(np.int64), starts).tolist() for x in (
        (codes & EMPTY) > 0, (codes & COPY) > 0, cut, bad)]
    out = {f.name: [] for f in PIECE.fields}
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        own = codes[a:b].tobytes()
        inside = 0 < k < len(starts) - 1
        cost = audit = costs = None
        if inside:
            total, v, _ = backward(own, END)
            cost = total + v[NONE]
            audit, state = walk(own, END, NONE)
            audit += closing(state)
        else:
            costs = matrix(own)
        for name, value in zip(out, (
                int(pos[rows[a]]), inside, cost, audit, *(c[k] for c in counts),
                own[0] & 3, own[-1] & 3, costs, None if inside else own), strict=True):
            out[name].append(value)
    ids = who.take(pa.array(starts))
    columns = [pa.array(out[f.name], _arrow(f.dataType)) for f in PIECE.fields]
    return pa.table([ids, *columns], ["conv_id", *out])


def _arrow(kind) -> pa.DataType:
    return {"bigint": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(),
            "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}[kind.simpleString()]


def _borders(table: pa.Table) -> pa.Table:
    """One conversation's border pieces: the vector after each, the cost of the
    whole and the illegal seams (on its first piece)."""
    table = table.sort_by("start")
    v, after = np.array(END), []
    for costs in reversed(table["costs"].to_pylist()):
        after.append(v.tolist())
        v = np.minimum((np.array(costs).reshape(4, 4) + v).min(axis=1), FAR)
    first, last = table["first"].to_pylist(), table["last"].to_pylist()
    seams = sum((a, b) not in LEGAL for a, b in zip(last, first[1:], strict=False))
    n = table.num_rows
    return pa.table({"start": table["start"], "after": pa.array(after[::-1], pa.list_(pa.int64())),
                     "final": pa.array([i == n - 1 for i in range(n)]),
                     "whole_cost": pa.array([int(v[NONE])] + [0] * (n - 1), pa.int64()),
                     "seams": pa.array([seams] + [0] * (n - 1), pa.int64())})


def _starts(table: pa.Table) -> pa.Table:
    """One conversation's border pieces: the state in which each begins."""
    table = table.sort_by("start")
    state, out = NONE, []
    for to in table["ends"].to_pylist():
        out.append(state)
        state = to[state]
    return pa.table({"start": table["start"], "state": pa.array(out, pa.int32())})


def _relative(v) -> Vector:
    least = min(v)
    return tuple(x if x >= FAR else x - least for x in v)


def _ends(batches):
    for b in batches:
        ends = [[walk(c, _relative(v), s)[1] for s in range(4)] for c, v in zip(
            b.column("codes").to_pylist(), b.column("after").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [b.column("conv_id"), b.column("start"), pa.array(ends, pa.list_(pa.int32()))],
            ["conv_id", "start", "ends"])


def _audits(batches):
    for b in batches:
        out = []
        for c, v, s, final in zip(*(b.column(x).to_pylist() for x in (
                "codes", "after", "state", "final")), strict=True):
            audit, state = walk(c, _relative(v), s)
            out.append(audit + closing(state) if final else audit)
        yield pa.RecordBatch.from_arrays([b.column("start"), pa.array(out, pa.string())],
                                         ["start", "audit"])


ORDER = ("conv_id", "turn", "role", "_head", "_hash")


def _keyed(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls: one space) and the order of rows."""
    return (take_columns(rows, "conv_id", "turn", "role", "text")
            .withColumns({"role": F.coalesce("role", F.lit(" ")),
                          "text": F.coalesce("text", F.lit(" "))})
            .withColumns({"_head": F.left("text", F.lit(HEAD)), "_hash": F.xxhash64("text")}))


def _ordered(keyed: DataFrame) -> DataFrame:
    """conv_id, turn, pos (the order of all rows), code, same (names role and
    text).  Texts themselves are not moved."""
    text = F.rtrim("text", F.lit(BLANKS))
    initial = F.lit(OTHER)
    for letter, i in INITIALS.items():
        initial = F.when(F.left("role", F.lit(1)) == letter, i).otherwise(initial)
    code = F.when(text == "", EMPTY).when(F.right(text, F.lit(1)).isin(".", "!", "?"), 0) \
        .otherwise(CUT) + initial
    # rows equal in all of ORDER are told apart, so a range can end between them
    thin = keyed.select(*ORDER, code.cast("int").alias("code"),
                        F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))).alias("same"),
                        F.monotonically_increasing_id().alias("_salt"))
    return cut_lineage(thin.repartitionByRange(*ORDER, "_salt").sortWithinPartitions(*ORDER, "_salt")
                       .select("conv_id", "turn", F.monotonically_increasing_id().alias("pos"),
                               "code", "same"))


def _pieces(ordered: DataFrame, chunk_bits: int) -> DataFrame:
    """Every piece of a conversation in a chunk, with its audit."""
    chunk = F.shiftright("pos", chunk_bits).alias("chunk")
    first = (ordered.filter(F.col("code") < EMPTY).groupBy("conv_id", "same")
             .agg(F.min("pos").alias("pos")))
    both = ordered.select(chunk, "conv_id", "pos", "code").unionByName(
        first.select(chunk, "conv_id", "pos", F.lit(COPY).alias("code")))
    schema = T.StructType([ordered.schema["conv_id"], *PIECE.fields])
    pieces = cut_lineage(both.groupBy("chunk").applyInArrow(_solve_chunk, schema))
    border = pieces.filter("NOT inside")
    along = border.select("conv_id", "start", "costs", "first", "last").groupBy("conv_id") \
        .applyInArrow(_borders, "start long, after array<long>, final boolean, "
                                "whole_cost long, seams long")
    along = cut_lineage(border.select("conv_id", "start", "codes").join(along, "start"))
    id_type = ordered.schema["conv_id"].dataType.simpleString()
    states = (along.select("conv_id", "start", "codes", "after")
              .mapInArrow(_ends, f"conv_id {id_type}, start long, ends array<int>")
              .groupBy("conv_id").applyInArrow(_starts, "start long, state int"))
    said = (along.join(states, "start").select("start", "codes", "after", "state", "final")
            .mapInArrow(_audits, "start long, audit string"))
    solved = (border.drop("audit", "cost").join(along.drop("conv_id", "codes"), "start").join(said, "start")
              .select("conv_id", "start", F.col("whole_cost").alias("cost"), "audit", "blank",
                      "duplicate", "truncated", (F.col("illegal") + F.col("seams")).alias("illegal")))
    return pieces.filter("inside").select(*solved.columns).unionByName(solved)


def audits(rows: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """One row a conversation of ``rows`` (conv_id, turn, role, text): conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit.

    Null roles and texts are one space.  Rows of a null conv_id are one
    conversation, its id null.  Equal rows of one turn are the first and its
    duplicates; other ties of a turn go by role and text.  Texts of any length
    count; an empty table has no conversations.  ``gaps`` is null where no long
    holds it."""
    ordered = _ordered(_keyed(rows))
    number = F.col("turn").cast("decimal(20,0)")
    gaps = (ordered.groupBy("conv_id").agg(
        F.max(number).alias("_hi"), F.min(number).alias("_lo"), F.countDistinct("turn").alias("_n"))
        .select("conv_id", F.when(F.col("_hi").isNull(), F.lit(0).cast("long")).otherwise(
            (F.col("_hi") - F.col("_lo") + 1 - F.col("_n")).try_cast("long")).alias("gaps")))
    said = F.sort_array(F.collect_list(F.struct("start", "audit")))
    whole = _pieces(ordered, chunk_bits).groupBy("conv_id").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(said, lambda x: x["audit"]), "").alias("audit"))
    return (gaps.withColumnRenamed("conv_id", "_id")
            .join(whole, F.col("_id").eqNullSafe(F.col("conv_id")))
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"))


def _stream(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order, all in one partition."""
    keyed = _keyed(rows)
    no = F.lit(None)
    return (found.select("conv_id", F.lit(0).alias("kind"), no.cast("long").alias("turn"),
                         no.cast("string").alias("role"), no.cast("string").alias("_head"),
                         no.cast("long").alias("_hash"), F.col("audit").alias("text"))
            .unionByName(keyed.withColumn("kind", F.lit(1)).select(
                "conv_id", "kind", F.col("turn").cast("long"), "role", "_head", "_hash", "text"))
            .repartition("conv_id").sortWithinPartitions("conv_id", "kind", *ORDER[1:])
            .select("conv_id", "kind", "role", "text"))


def _edited(batches):
    """(conv_id, None) as a conversation begins, then (conv_id, (edit, role,
    text)) for each repaired row."""
    conv, audit, at, state = None, "", 0, NONE

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, AFTER[state]
            yield conv, ("I", ROLE[state], "")

    for b in batches:
        for own, kind, role, text in zip(*(b.column(c).to_pylist() for c in (
                "conv_id", "kind", "role", "text")), strict=True):
            if kind == 0:
                yield from inserted()
                conv, audit, at, state = own, text, 0, NONE
                yield conv, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = INITIALS[role[0]] + 1
                yield conv, (edit, role, text)
            elif edit == "R":
                state = AFTER[state]
                yield conv, (edit, ROLE[state], text)
    yield from inserted()


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), edit (K, R or I), role, text.
    ``found``: the audits of ``rows``."""
    id_type = found.schema["conv_id"].dataType.simpleString()

    def out(batches):
        held, place = [], 0
        for conv, row in _edited(batches):
            if row is None:
                place = 0
                continue
            held.append((conv, place, *row))
            place += 1
            if len(held) == 4096:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    return _stream(rows, found).mapInArrow(
        out, f"conv_id {id_type}, place long, edit string, role string, text string")


def _batch(held):
    return pa.RecordBatch.from_pydict(dict(zip(
        ("conv_id", "place", "edit", "role", "text"), map(list, zip(*held, strict=True)), strict=True)))


def repaired_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of each conversation's repaired ``role:text``,
    joined by newlines, hashed row by row as they stream by."""
    id_type = found.schema["conv_id"].dataType.simpleString()

    def out(batches):
        digest, last, done, held = None, None, None, []
        for conv, row in _edited(batches):
            if row is None:
                if digest is not None:
                    held.append((last, digest.hexdigest()))
                digest, last, done = hashlib.sha256(), conv, False
            else:
                digest.update((("\n" if done else "") + row[1] + ":" + row[2]).encode())
                done = True
            if len(held) == 4096:
                yield _digests(held)
                held = []
        if digest is not None:
            held.append((last, digest.hexdigest()))
        if held:
            yield _digests(held)

    return _stream(rows, found).mapInArrow(out, f"conv_id {id_type}, repaired_sha256 string")


def _digests(held):
    return pa.RecordBatch.from_pydict({"conv_id": [x for x, _ in held],
                                       "repaired_sha256": [x for _, x in held]})


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` damaged by crc32 of ``conv_id:turn``, modulo 20: 0 drops a row,
    1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it the
    user's.  Nulls are written as one space."""
    space = F.lit(" ")
    rows = take_columns(rows, "conv_id", "turn", "role", "text")
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space))) % 20
    return (rows.withColumn("_fate", fate).filter("_fate <> 0")
            .withColumn("_n", F.explode(F.when(F.col("_fate") == 3, F.array(F.lit(1), F.lit(2)))
                                        .otherwise(F.array(F.lit(1)))))
            .select("conv_id", "turn",
                    F.when(F.col("_fate") == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
                    F.when(F.col("_fate") == 1, "").when(
                        F.col("_fate") == 2, F.translate(F.coalesce("text", space), ".!?", ""))
                    .otherwise(F.coalesce("text", space)).alias("text")))


def damaged_and_repaired(conversations: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """The contract's row for every conv_id of ``conversations``; one without
    rows after the damage has zeros, no audit and the hash of an empty string."""
    rows = damage(conversations)
    found = cut_lineage(audits(rows, chunk_bits))
    digests = repaired_digests(rows, found)
    all_ids = take_columns(conversations, "conv_id").distinct().withColumnRenamed("conv_id", "_id")
    both = all_ids.join(found, F.col("_id").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    both = both.join(digests, F.col("_id").eqNullSafe(F.col("conv_id")), "left")
    gaps = F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps"))
    return both.select(
        F.col("_id").alias("conv_id"), gaps.alias("gaps"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c)
          for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Contract query: damage and repair of every conversation."""
    return damaged_and_repaired(
        read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
