"""Conversation repair against an enumeration of all edits, a left-to-right search, and the damage worked out in Python."""

from __future__ import annotations

import random
import re
import zlib
from itertools import product

import pytest

from claimlens.llm import conversation_repair as cr
from claimlens.llm.common import Stages
from claimlens.llm.queries import QUERIES
from conftest import SF_SMALL
from test_llm_cases import sha

LEGAL = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string, conv string, pos int, seq string, row long"


def faults(rows: list[tuple[str, str]]) -> list[str]:
    out, seen = [], set()
    for role, text in rows:
        ink = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def enumerated(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """Every edit of every row, with up to two insertions in every gap."""
    gaps = [[(5 * n, "I" * n, "".join(x)) for n in range(3) for x in product("ua", repeat=n)]] * (len(rows) + 1)
    steps = [gaps[0]]
    for (role, _), fault, gap in zip(rows, faults(rows), gaps[1:]):
        edits = [(2, "D", "")]
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            edits += [(more, "K", role[:1] or "?"), (1 + more, "R", "u"), (1 + more, "R", "a")]
        steps += [edits, gap]
    return min((sum(s[0] for s in way), "".join(s[1] for s in way)) for way in product(*steps)
               if LEGAL.fullmatch("".join(s[2] for s in way)))


def searched(rows: list[tuple[str, str]]) -> tuple[int, str]:
    """The least (cost, audit) from the left, by the last role initial that is out."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    def filled(best):
        for _ in range(2):
            for last, (cost, audit) in list(best.items()):
                for role in follow[last].replace("s", ""):
                    best[role] = min(best.get(role, (9e9, "")), (cost + 5, audit + "I"))
        return best

    best = filled({"": (0, "")})
    for (role, _), fault in zip(rows, faults(rows)):
        new = {}
        for last, (cost, audit) in best.items():
            ways = [(last, 2, "D")]
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                ways += [(r, more, "K") for r in follow[last] if role[:1] == r] + [(r, more + 1, "R") for r in follow[last] if r != "s"]
            for to, price, edit in ways:
                new[to] = min(new.get(to, (9e9, "")), (cost + price, audit + edit))
        best = filled(new)
    return min(best[e] for e in ("", "a") if e in best)


def applied(rows: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    kept = [(e, None if e == "I" else next(it)) for it in [iter(rows)] for e in audit]
    kept = [x for x in kept if x[0] != "D"]
    odd = len(kept) % 2
    return [row if e == "K" else (("user", "assistant")[(k - odd) % 2], "" if e == "I" else row[1]) for k, (e, row) in enumerate(kept)]


def damage(rows: list[tuple]) -> dict:
    """conv_id -> rows after the damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1))
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rs in out.items()}


def digest(conv, rows: list[tuple]) -> tuple:
    if not rows:
        return (conv, 0, 0, 0, 0, 0, 0, "", sha(""))
    turns, texts = [r[0] for r in rows if r[0] is not None], [r[1:] for r in rows]
    fault, roles = faults(texts), [r[0][:1] for r in texts]
    cost, audit = searched(texts)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (conv, gaps, *(fault.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:])), cost, audit,
            sha("\n".join(f"{r}:{t}" for r, t in applied(texts, audit))))


def symbols(rows: list[tuple[str, str]]) -> str:
    kind = {"": cr.SOUND, "truncated": cr.TRUNCATED, "blank": cr.TO_DELETE, "duplicate": cr.TO_DELETE}
    return "".join(chr(65 + 4 * kind[f] + ("sua".find(r[:1]) if r[:1] in "sua" and r else 3)) for (r, _), f in zip(rows, faults(rows)))


def drawn(rng: random.Random, n: int) -> list[tuple[str, str]]:
    return [(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""]),
             rng.choice(["Yes.", "No!", "cut", " ", f"t{rng.random()}.", f"t{rng.random()}?", f"c{rng.random()}"])) for _ in range(n)]


def test_cells_against_all_edits():
    rng = random.Random(3)
    for n in (1, 1, 2, 2, 2, 3, 3, 3, 3):
        rows = drawn(rng, n)
        assert cr.cheapest(cr.parsed(symbols(rows))) == enumerated(rows) == searched(rows)


def test_cells_against_search_from_the_left():
    rng = random.Random(4)
    for _ in range(300):
        rows = drawn(rng, rng.randint(1, 40))
        cost, audit = cr.cheapest(cr.parsed(symbols(rows)))
        assert (cost, audit) == searched(rows)
        assert LEGAL.fullmatch("".join(r[:1] for r, _ in applied(rows, audit)))


def test_any_split_gives_the_same_cells():
    rng = random.Random(5)
    for _ in range(60):
        s = symbols(drawn(rng, rng.randint(2, 12)))
        for k in range(1, len(s)):
            assert cr.combined(cr.parsed(s[:k]), cr.parsed(s[k:])) == cr.parsed(s)


def odd_rows() -> list[tuple]:
    rng = random.Random(6)
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."),
            (1, 5, "assistant", "Yes. "), (2, None, "user", "Only."), (None, 0, "user", "No id."), (None, 1, "assistant", "Ok!"),
            (3, 0, "", ""), (4, 7, "assistant", " \t" * 40000 + "x" * 100000), (4, 9, "user", "." + " " * 50000)]
    rows += [(5, t, r, x) for t, (r, x) in enumerate(drawn(rng, 9000))]  # three levels of spans
    rows += [(6, t % 3, "user", "Same.") for t in range(500)]
    return rows + [(c, t, r, x) for c in range(10, 60) for t, (r, x) in enumerate(drawn(rng, rng.randint(1, 70)))]


def test_odd_rows_against_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "c", 3, "s", 9) for r in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in cr.repair_digests(df).collect()), key=repr)
    after = damage(rows)
    assert got == sorted((digest(c, after[c]) for c in after), key=repr)
    assert cr.repair_digests(df.limit(0)).collect() == []


def test_operator_returns_the_repaired_rows(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "c", 3, "s", 9) for r in rows if r[0] != 5], SCHEMA)
    found = cr.repair(df, Stages(spark))
    got = {}
    for r in sorted(found.rows.collect(), key=lambda r: (repr(r.conv), r.seq)):
        got.setdefault(r.conv, []).append((r.role, r.text))
    for c in found.conversations.collect():
        own = sorted(((t, " " if r is None else r, " " if x is None else x) for i, t, r, x in rows if i == c.conv),
                     key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        assert got.get(c.conv, []) == applied([r[1:] for r in own], c.audit)


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = damage(rows)
    got = sorted(tuple(r) for r in QUERIES["op13_conversation_repair"](spark, SF_SMALL).collect())
    assert got == sorted(digest(c, after[c]) for c in after)


@pytest.mark.parametrize("rows, want", [
    ([("user", "A."), ("assistant", "B.")], (0, "KK")), ([("system", "A.")], (2, "D")), ([("user", "A.")], (2, "D")),
    ([("assistant", "A."), ("user", "B.")], (2, "RR")), ([("user", "A."), ("user", "B.")], (1, "KR")),
    ([("system", "S."), ("user", "A."), ("assistant", "B")], (4, "RRD")),
])
def test_hand_worked(rows, want):
    assert cr.cheapest(cr.parsed(symbols(rows))) == want == searched(rows)
