import hashlib
import itertools
import random
import re
import zlib

import pytest

from corpuscope.llm import repair as module
from corpuscope.llm.registry import QUERIES
from corpuscope.llm.repair import Search, Turn, damaged, repair
from tests.conftest import DATA

PATTERN = re.compile(r"(s?(ua)+)?")
WHITE = " \t\n\x0b\f\r"
COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        lot = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if lot == 1:
            text = ""
        if lot == 2:
            text = re.sub("[.!?]", "", text)
        if lot == 4:
            role = "user"
        out += [] if lot == 0 else [(conv, turn, role, text)] * (2 if lot == 3 else 1)
    return out


def faults(rows):
    seen, found = set(), []
    for _, _, role, text in rows:
        if not text.strip(WHITE):
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append("truncated" if text.rstrip(WHITE)[-1] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(rows, found):
    """Least cost, edits and roles by dynamic programming over prefixes of the role pattern, independent of the search."""
    best = {"": (0, "", ())}  # what the roles so far end in: cost, edits, (row or None, role)

    def better(table, state, option):
        if state not in table or option[:2] < table[state][:2]:
            table[state] = option

    def inserted(table):
        out = dict(table)
        for _ in range(4):
            for state, (cost, edits, left) in list(out.items()):
                role = "assistant" if state == "u" else "user"
                better(out, role[0], (cost + 5, edits + "I", (*left, (None, role))))
        return out

    for i, (_, _, role, _) in enumerate(rows):
        following = {}
        for state, (cost, edits, left) in inserted(best).items():
            better(following, state, (cost + 2, edits + "D", left))
            if found[i] in ("blank", "duplicate"):
                continue
            more = 5 if found[i] == "truncated" else 0
            for edit, to, price in [("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)]:
                if to and state + to[0] in ("u", "s", "su", "ua", "au"):
                    better(following, to[:1], (cost + more + price, edits + edit, (*left, (i, to))))
        best = following
    # edits of one length so far may go on in several ways: all are compared whole
    return min(o for s, o in inserted(best).items() if s in ("", "a"))


def brute(rows):
    out = []
    for conv in dict.fromkeys(r[0] for r in rows):
        mine = damage([r for r in rows if r[0] == conv])
        mine.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        found = faults(mine)
        cost, audit, left = cheapest(mine, found)
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        text = "\n".join(f"{role}:{'' if i is None else mine[i][3]}" for i, role in left)
        out.append(
            (
                conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                *(found.count(k) for k in ("blank", "duplicate", "truncated")),
                sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
                cost, audit, hashlib.sha256(text.encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


def repaired(llm, rows):
    df = llm.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "'x' AS seg", "1 AS place", "2 AS cost")
    return repair(damaged(df), df)


def made(seed, size, conv=0):
    pick = random.Random(seed)
    rows = []
    for turn in range(size):
        role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
        text = pick.choice([f"Say {pick.randrange(50)}.", f"Say {pick.randrange(50)}.", "cut", "", " \t\n", None, "A! \n"])
        rows.append((conv, turn // 2 if pick.random() < 0.2 else None if pick.random() < 0.05 else turn, role, text))
    return rows


def accepted(turns, edits):
    """Roles after some edits, None where they do not fit."""
    for wanted in ["", "s"]:
        roles, rest = "", list(turns)
        for edit in edits:
            following = {"": wanted or "u", "u": "a"}.get(roles[-1:], "u")
            if edit == "I":
                roles += "u" if following == "s" else following
                continue
            turn = rest.pop(0)
            if edit == "D":
                continue
            if turn.lost:
                break
            if edit == "R":
                roles += "u" if following == "s" else following
            else:
                roles += turn.initial
        else:
            if not rest and PATTERN.fullmatch(roles):
                return True
    return False


def test_search_against_all_edits():
    pick = random.Random(4)
    price = {"D": 2, "I": 5, "K": 0, "R": 1}
    for _ in range(60):
        turns = [
            Turn(pick.choice("suat"), lost=pick.random() < 0.2) if pick.random() < 0.7 else Turn(pick.choice("ua"), extra=5)
            for _ in range(pick.randrange(5))
        ]
        options = []
        for length in range(len(turns), len(turns) + 3):
            for edits in map("".join, itertools.product("DIKR", repeat=length)):
                kept = [e for e in edits if e != "I"]
                if len(kept) == len(turns) and accepted(turns, edits):
                    extra = sum(t.extra for t, e in zip(turns, kept, strict=True) if e != "D")
                    options.append((sum(price[e] for e in edits) + extra, edits))
        assert Search(turns).cheapest(0) == min(options)


@pytest.mark.parametrize("segment", [256, 3])
def test_repair_matches_brute_force(llm, monkeypatch, segment):
    monkeypatch.setattr(module, "SEGMENT", segment)
    rows = [r for conv in range(40) for r in made(conv, random.Random(conv).randrange(14), conv)]
    rows += made(99, 9, None) + made(98, 60, 1000) + [(500, None, "user", "Hi."), (500, None, "user", "Hi.")]
    rows += [(501, t, "user", "same.") for t in range(30)] + [(502, 0, "system", "a" * 200_000)]
    random.Random(0).shuffle(rows)
    assert rows_of(repaired(llm, rows)) == brute(rows)


def test_long_conversation(llm):
    rows = made(7, 3000, 1)
    assert rows_of(repaired(llm, rows)) == brute(rows)


def test_empty_and_dropped(llm):
    assert rows_of(repaired(llm, [])) == []
    dropped = next((c, t) for c in range(99) for t in range(99) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert rows_of(repaired(llm, [(*dropped, "user", "Hi.")])) == [
        (dropped[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    ]


def test_query_on_the_table(llm):
    rows = [tuple(r) for r in llm.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(QUERIES["op12_repair_conversations"](llm, DATA)) == brute(rows)
