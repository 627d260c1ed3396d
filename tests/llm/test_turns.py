"""Operator 12 against an exhaustive search over edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from papersieve.llm import turns
from papersieve.llm.frames import read_table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(c, t, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        out.append("blank" if BLANK.match(text) else "duplicate" if (role, text) in seen
                   else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, bad):
    """(cost, audit, repaired rows) by trying every edit at every place."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, room):
        out = []
        if i == len(rows) and last in ("", "a"):
            out.append((0, "", ()))

        def add(cost, edit, initial, row, to, room):
            if initial and initial not in follow[last]:
                return
            c, a, r = best(to, initial or last, room)
            out.append((cost + c, edit + a, (row, *r) if row else r))

        if room:
            for role in ("user", "assistant"):
                add(3, "I", role[0], (role, ""), i, room - 1)
        if i < len(rows):
            _, _, role, text = rows[i]
            add(4, "D", "", None, i + 1, 3)
            if bad[i] not in ("blank", "duplicate"):
                more = 3 if bad[i] else 0
                if role[:1] in ("s", "u", "a"):
                    add(more, "K", role[0], (role, text), i + 1, 3)
                for new in ("user", "assistant"):
                    add(3 + more, "R", new[0], (new, text), i + 1, 3)
        return min(out, key=lambda x: x[:2]) if out else (10**9, "", ())

    return best(0, "", 3)


def brute(rows):
    out = {}
    after = damaged(rows)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == c),
                     key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        bad = faults(own)
        known = [r[1] for r in own if r[1] is not None]
        cost, audit, fixed = cheapest(own, bad)
        pairs = [own[i][2][:1] + own[i + 1][2][:1] for i in range(len(own) - 1)]
        out[c] = (max(known) - min(known) + 1 - len(set(known)) if known else 0,
                  bad.count("blank"), bad.count("duplicate"), bad.count("truncated"),
                  sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                  hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def as_dict(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit,
                       r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def random_rows(seed, conversations=60):
    draw = random.Random(seed)
    rows = []
    for c in [*range(conversations), None]:
        for t in range(draw.randrange(1, 9)):
            for _ in range(2 if draw.random() < .1 else 1):
                turn = None if draw.random() < .05 else draw.choice([t, t, t, t + 3])
                role = draw.choice(["user", "assistant", "assistant", "system", "tool", "", None, "u"])
                text = draw.choice(["Yes.", "no", "a?", "", " \t", None, "x! ", f"w{t}.", "é…"])
                rows.append((c, turn, role, text))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", F.lit(1).alias("TURN"), F.lit("x").alias("audit"), F.lit(2).alias("pos"))


@pytest.mark.parametrize("bits", [turns.CHUNK_BITS, 2])
def test_equals_exhaustive_search(spark, bits):
    rows = random_rows(5)
    assert as_dict(turns.damaged_and_repaired(frame(spark, rows), bits)) == brute(rows)


def test_query_equals_exhaustive_search(spark):
    rows = [tuple(r) for r in read_table(spark, SMALL, "conversations", "conv_id", "turn", "role",
                                         "text").collect()]
    assert as_dict(turns.conversation_repair(spark, SMALL)) == brute(rows)


def test_one_conversation_over_many_chunks(spark):
    draw = random.Random(2)
    rows = [(7, i, draw.choice(["user", "assistant", "assistant", "tool"]), f"{i}" + draw.choice(".!x"))
            for i in range(900)] + [(8, 1, "user", "Hi.")]
    one = as_dict(turns.damaged_and_repaired(frame(spark, rows)))
    assert as_dict(turns.damaged_and_repaired(frame(spark, rows), 4)) == one
    own = [r for r in damaged(rows) if r[0] == 7]
    code = bytes({"u": 1, "a": 2}.get(r[2][0], 3) + {"truncated": 4, "blank": 8, "duplicate": 16}
                 .get(f, 0) for r, f in zip(own, faults(own), strict=True))
    total, v, _ = turns.backward(code, turns.END)
    assert one[7][5] == total + v[0] and re.fullmatch("[DIKR]*", one[7][6])


def test_edges(spark):
    assert turns.damaged_and_repaired(frame(spark, [])).count() == 0
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hi."), (None, None, None, None), (3, 2**63 - 1, "user", "a."),
            (3, -2**63, "assistant", "long " * 200000)] + [(4, 5, "user", "same.")] * 40
    got = as_dict(turns.damaged_and_repaired(frame(spark, rows), 3))
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got[4][2] == len([r for r in damaged(rows) if r[0] == 4]) - 1
    assert got[3][0] is None and set(got) == {gone, None, 3, 4}


def test_repaired_rows_have_the_form(spark):
    rows = frame(spark, [r for r in random_rows(9) if r[0] is not None])
    out = turns.repaired(rows, turns.audits(rows)).orderBy("conv_id", "place").collect()
    by = {}
    for r in out:
        by.setdefault(r.conv_id, []).append(r)
    for own in by.values():
        assert [r.place for r in own] == list(range(len(own)))
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r.role[0] for r in own))
        assert all(r.text == "" for r in own if r.edit == "I")
