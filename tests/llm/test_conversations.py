"""Repairs against a plain dynamic programme over all edits."""

import hashlib
import itertools
import random
import re

import pytest

from ledgerloom.llm import conversations
from ledgerloom.llm.conversations import cheapest

GIVES = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def plain(symbols):
    """Least (cost, audit) by a table over rows and states."""
    def grown(best):
        for _ in range(3):
            for q, (cost, audit) in list(best.items()):
                to = GIVES[q][1]
                best[to] = min(best.get(to, (10**9,)), (cost + 5, audit + "I"))
        return best

    best = grown({0: (0, "")})
    for c in symbols:
        after = {}
        for q, (cost, audit) in best.items():
            ways = [(q, 2, "D")]
            if c != "-":
                more = 5 * c.isupper()
                ways.append((GIVES[q][1], 1 + more, "R"))
                if (q, c.lower()) in KEEPS:
                    ways.append((KEEPS[q, c.lower()], more, "K"))
            for to, cost_of, edit in ways:
                after[to] = min(after.get(to, (10**9,)), (cost + cost_of, audit + edit))
        best = grown(after)
    return min(best[q] for q in (0, 3) if q in best)


def test_search_equals_table_on_all_short_sequences():
    for n in range(5):
        for symbols in itertools.product("suaxUA-", repeat=n):
            assert cheapest("".join(symbols)) == plain(symbols)


def test_search_equals_table_on_long_sequences():
    random.seed(5)
    for n in (30, 200):
        for _ in range(40):
            symbols = "".join(random.choices("suaxSUAX-", (1, 6, 6, 1, 1, 2, 2, 1, 3), k=n))
            assert cheapest(symbols) == plain(symbols)


def brute(rows):
    """All results of a table of (conv_id, turn, role, text)."""
    found = {}
    for conv in {r[0] for r in rows}:
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1][:64].encode(), r[2][:64].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, symbols, faults = set(), "", []
        for _, role, text in own:
            rest = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else ""
            seen.add((role, text))
            initial = role[0] if role[:1] in tuple("sua") else "x"
            symbols += "-" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
            faults.append(fault)
        cost, audit = plain(symbols)
        lines, state, left = [], 0, list(own)
        for edit in audit:
            _, role, text = (None, None, "") if edit == "I" else left.pop(0)
            if edit == "K":
                state = KEEPS[state, role[0]]
            elif edit in "RI":
                name, state = GIVES[state]
                role = {"u": "user", "a": "assistant"}[name]
            if edit != "D":
                lines.append((role, text))
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in lines))
        turns = [t for t, _, _ in own if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        found[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, lines)
    return found


def check(spark, rows, block):
    got = conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, key string, place int"), block)
    want = brute([r[:4] for r in rows])
    audits = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in got.audits.collect()}
    assert audits == {c: w[:-1] for c, w in want.items()}
    lines = {}
    for r in sorted(got.rows.collect(), key=lambda r: (r.place, r.step)):
        lines.setdefault(r.conv_id, []).append((r.role, r.text))
        assert (r.edit == "I") == (r.text == "")
    assert lines == {c: w[-1] for c, w in want.items() if w[-1]}
    digests = {r.conv_id: r.sha256 for r in conversations.conversation_digests(got.rows).collect()}
    assert digests == {c: hashlib.sha256("\n".join(f"{a}:{b}" for a, b in v).encode()).hexdigest() for c, v in lines.items()}


@pytest.mark.parametrize("block", [3, 4096])
def test_repair_equals_brute_force(spark, block):
    random.seed(11)
    rows = []
    for conv in [*range(25), None]:
        n = 300 if conv == 7 else random.randrange(1, 12)
        for k in range(n):
            turn = random.choice([k, k, k, k + 1, None])
            role = random.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "ünknown"])
            text = random.choice(["Yes.", f"No {k}!", f"No {k}!\n\t", "So?", f"cut {k}", " \t", "", None, "。", "\x1c", "x" * 70 + str(k) + "."])
            rows.append((conv, turn, role, text, "k", 3))
    check(spark, rows, block)


def test_no_rows(spark):
    got = conversations.repair(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert got.audits.count() == 0 and conversations.conversation_digests(got.rows).count() == 0


def test_damage(spark):
    from ledgerloom.llm.queries import damaged

    rows = [(None, None, None, None), *[(1, k, "assistant", "A. B!") for k in range(60)]]
    got = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    import zlib

    want = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k:
            row = (conv, turn, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            want += [row] * (2 if k == 3 else 1)
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:4]) for r in got)
