"""Conversation repair against an enumeration of all edits."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from relata.llm import repair

TURNS = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def after_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        drawn = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if drawn == 0:
            continue
        text = "" if drawn == 1 else re.sub("[.!?]", "", text) if drawn == 2 else text
        own += [(turn, "user" if drawn == 4 else role, text)] * (2 if drawn == 3 else 1)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    return {conv: sorted(own, key=order) for conv, own in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(conv, rows):
    """Every edit of every row, with every insertion of up to two rows at every place."""
    told = faults(rows)
    edits = [[("D", 4, None)] + ([] if f in ("blank", "duplicate") else [("K", 3 * (f == "truncated"), role), *(("R", 3 + 3 * (f == "truncated"), r) for r in ("user", "assistant"))]) for f, (_, role, _) in zip(told, rows)]
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    best = None
    for inserted in product(gaps, repeat=len(rows) + 1):
        fixed = 3 * sum(map(len, inserted))
        if best and fixed > best[0]:
            continue
        for chosen in product(*edits):
            cost, audit, lines = fixed, "", []
            for k in range(len(rows) + 1):
                audit += "I" * len(inserted[k])
                lines += [(r, "") for r in inserted[k]]
                if k < len(rows):
                    letter, price, role = chosen[k]
                    cost, audit = cost + price, audit + letter
                    if role is not None:
                        lines.append((role, rows[k][2]))
            if (best is None or (cost, audit) < best[:2]) and all(r for r, _ in lines) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines)):
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in lines))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (_, a, _), (_, b, _) in zip(rows, rows[1:]))
    counts = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(told.count(f) for f in ("blank", "duplicate", "truncated")), illegal)
    return (conv, *counts, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())


def found(spark, rows, schema=TURNS):
    return sorted((tuple(r[c] for c in COLUMNS) for r in repair.repair_damaged(spark.createDataFrame(rows, schema)).collect()), key=repr)


def drawn_rows(seed, conversations, most):
    rng = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", "", None, "User", "agent"]
    texts = ["Yes.", "No", "Why?", "", " \n", None, "well\t", "Done!\n", "Yes."]
    out = []
    for conv in range(conversations):
        out += [(None if conv == 3 else conv, rng.choice([k, k, k, k + 1, None]), rng.choice(roles), rng.choice(texts)) for k in range(rng.randrange(1, most))]
    return out


@pytest.mark.parametrize("limits", [(1024, 512), (1, 1), (2, 2), (1, 3)])
def test_repair_equals_all_edits(spark, monkeypatch, limits):
    monkeypatch.setattr(repair, "LONG_ROWS", limits[0])
    monkeypatch.setattr(repair, "BLOCK_ROWS", limits[1])
    rows = drawn_rows(5, 120, 5)
    expected = sorted((brute(c, own) for c, own in after_damage(rows).items() if len(own) <= 4), key=repr)
    kept = {e[0] for e in expected}
    assert len(expected) > 90 and [f for f in found(spark, rows) if f[0] in kept] == expected


def test_long_conversations_equal_short_ones(spark, monkeypatch):
    rows = drawn_rows(8, 12, 60) + [(500, 1, "user", f"Same {k % 3}.") for k in range(400)]
    whole = found(spark, rows)
    monkeypatch.setattr(repair, "LONG_ROWS", 5)
    for size in (1, 7):
        monkeypatch.setattr(repair, "BLOCK_ROWS", size)
        assert found(spark, rows) == whole
    monkeypatch.setattr(repair, "BATCH_ROWS", 10)
    assert found(spark, rows) == whole


def test_odd_conversations(spark):
    empty = hashlib.sha256().hexdigest()
    assert found(spark, []) == []
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    assert found(spark, [(lost, 1, "user", "Hello.")]) == [(lost, 0, 0, 0, 0, 0, 0, "", empty)]
    kept = next(c for c in range(1000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 > 4 for t in (1, 2, 9)))
    long = "word " * 400_000 + "."
    rows = [(kept, 1, "user", long), (kept, 9, "assistant", "Yes.")]
    assert found(spark, rows) == [(kept, 7, 0, 0, 0, 0, 0, "KK", hashlib.sha256(f"user:{long}\nassistant:Yes.".encode()).hexdigest())]
    assert found(spark, [(kept, 1, "system", "Rules.")])[0][-3:] == (4, "D", empty)
    assert found(spark, [(kept, 1, "user", "Well?")])[0][-3:] == (3, "KI", hashlib.sha256(b"user:Well?\nassistant:").hexdigest())
    clashing = spark.createDataFrame([(kept, 1, "user", "Well?", "a", 1, True)], TURNS + ", key string, block int, `dropped.x` boolean")
    assert repair.repair_damaged(clashing).count() == 1
    names = spark.createDataFrame([("a", 1, "user", "Well?")], "conv_id string, turn int, role string, text string")
    assert repair.repair_damaged(names).first()["conv_id"] == "a"


def test_conversations_without_rows_after_damage_in_the_long_way(spark, monkeypatch):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    monkeypatch.setattr(repair, "LONG_ROWS", 2)
    assert found(spark, [(lost, 1, "user", "Hello.")] * 5 + [(lost + 1, 1, "user", "Hello.")]) [0][:2] == (lost, 0)


def test_lines_show_the_repaired_rows():
    lines = repair.Lines("IKDRI", keep=True)
    for role, text in (("assistant", "One."), ("user", ""), ("tool", "Two.")):
        lines.row(role, text)
    lines.end()
    assert lines.lines == ["user:", "assistant:One.", "user:Two.", "assistant:"]
