"""Repairs against a search over all edits, and against a path search on long conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from raterscope.llm import conversations as c

SCHEMA = "conv_id long, turn long, role string, text string, conv string, copies int, digest string, audit string, n int"


def all_edits(symbols):
    """Least (cost, audit) by trying every edit of every row, with up to two insertions at every place."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    options = []
    for s in symbols:
        own = [("D", "", 4)]
        if s != "-":
            extra = 3 if s.isupper() else 0
            own += [("K", s.lower(), extra), ("R", "u", 3 + extra), ("R", "a", 3 + extra)]
        options.append(own)
    for edits in itertools.product(*options):
        for between in itertools.product(gaps, repeat=len(symbols) + 1):
            roles = between[0] + "".join(e[1] + b for e, b in zip(edits, between[1:]))
            if re.fullmatch("(s?(ua)+)?", roles):
                cost = sum(e[2] for e in edits) + 3 * sum(map(len, between))
                audit = "I" * len(between[0]) + "".join(e[0] + "I" * len(b) for e, b in zip(edits, between[1:]))
                best = min(best or (cost, audit), (cost, audit))
    return best


def path(symbols):
    """Least (cost, audit) row by row over the four places."""

    def with_insertions(cells):
        for _ in range(3):
            for (p, role), q in c.MOVES.items():
                if p in cells and role in "ua":
                    new = (cells[p][0] + 3, cells[p][1] + "I")
                    cells[q] = min(cells.get(q, new), new)
        return cells

    cells = with_insertions({0: (0, "")})
    for s in symbols:
        after = {}
        for p, (cost, audit) in cells.items():
            found = [(p, cost + 4, "D")]
            if s != "-":
                extra = 3 if s.isupper() else 0
                for role in "sua":
                    if (p, role) in c.MOVES:
                        q = c.MOVES[p, role]
                        found += [(q, cost + extra, "K")] if s.lower() == role else []
                        found += [(q, cost + 3 + extra, "R")] if role != "s" else []
            for q, more, letter in found:
                new = (more, audit + letter)
                after[q] = min(after.get(q, new), new)
        cells = with_insertions(after)
    return min(cells[q] for q in (0, 3) if q in cells)


def parsed(symbols):
    parser = c.Parser()
    for s in symbols:
        parser.add(s)
    return parser.result()


def test_same_as_all_edits():
    for n in range(4):
        for symbols in itertools.product("suax-UA", repeat=n):
            assert parsed(symbols) == all_edits(symbols), symbols


@pytest.mark.parametrize("n", [5, 8, 9, 17, 64, 65, 200, 700])
def test_same_as_path(n):
    draw = random.Random(n)
    for _ in range(20):
        symbols = draw.choices("suaxSUAX-", [1, 9, 9, 1, 1, 2, 2, 1, 3], k=n)
        assert parsed(symbols) == path(symbols)


def plain(rows, damaged=True):
    """The contract, conversation by conversation."""
    space = lambda x: " " if x is None else x
    found = {}
    for conv in {r[0] for r in rows}:
        own = []
        for _, turn, role, text in [r for r in rows if r[0] == conv]:
            role, text = space(role), space(text)
            case = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20 if damaged else 9
            text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
            own += [(turn, "user" if case == 4 else role, text)] * {0: 0, 3: 2}.get(case, 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, symbols, faults = set(), [], []
        for _, role, text in own:
            rest = text.rstrip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not rest else "duplicate" if (role, text) in seen else "ok" if rest[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols.append("-" if fault in ("blank", "duplicate") else initial.upper() if fault == "truncated" else initial)
        cost, audit = path(symbols)
        lines, queue, place = [], list(own), 0
        for letter in audit:
            row = queue.pop(0) if letter != "I" else None
            if letter == "D":
                continue
            initial = row[1][0] if letter == "K" else "a" if place == 2 else "u"
            place = c.MOVES[place, initial]
            lines.append(f"{row[1] if letter == 'K' else c.NAMES[initial]}:{row[2] if row else ''}")
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for _, r, _ in own]
        found[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines,
        )
    return found


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], SCHEMA).repartition(3)


def same(spark, rows):
    found = {r["conv"]: tuple(r)[1:] for r in c.repaired_digests(c.damage(table(spark, rows))).collect()}
    assert found == {k: v[:-1] for k, v in plain(rows).items()}


AWKWARD = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 3, "assistant", "So"), (1, 3, "assistant", "So"), (1, 3, "user", "So."),
    (2, None, None, None), (2, 1, "user", ""), (2, 5, "tool", "x.\n\n \x0b"), (2, 5, "", "empty role."),
    (None, 1, "user", "a?"), (None, None, "assistant", "b!"), (None, 2, "assistant", "c."), (3, 1, "user", "x. " + "y " * 100_000),
    (4, -5, "assistant", "中文。"), (4, 900, "user", "é\x00 é."), (4, 900, "user", "é\x00 é."), (5, None, "user", " \t"),
]


def test_awkward_rows(spark):
    same(spark, AWKWARD)
    many = [(100 + i, t, role, text) for i in range(120) for _, t, role, text in AWKWARD[:5]]
    same(spark, many)


def test_long_and_hot(spark):
    draw = random.Random(7)
    rows = [(1, draw.randint(0, 900), draw.choice(["user", "assistant", "system"]), draw.choice("abcdefgh") + draw.choice([".", ""])) for _ in range(3000)]
    rows += [(2, 4, "user", "the same.")] * 500 + [(3 + i, i, "user", "Hi.") for i in range(200)]
    same(spark, rows)


def test_repaired_rows(spark):
    found = {}
    for r in c.repair(c.whole_rows(table(spark, AWKWARD))).orderBy("conv", "turn").collect():
        found.setdefault(r["conv"], []).append(f"{r['role']}:{r['text']}")
    assert found == {k: v[-1] for k, v in plain(AWKWARD, damaged=False).items() if v[-1]}


def test_nothing(spark):
    assert c.repaired_digests(c.damage(table(spark, AWKWARD[:1]).filter("false"))).count() == 0
    assert c.repair(c.whole_rows(table(spark, AWKWARD[:1]).filter("false"))).count() == 0
