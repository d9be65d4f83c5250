"""Repair of conversation structure by weighted CYK parsing.

A repaired conversation is an optional system turn and then pairs of a user and an assistant turn, or
nothing: its role initials match ``(s?(ua)+)?``. Rows are kept (K, cost 0), given the role user or assistant
(R, 3), deleted (D, 4; the only edit of blank and duplicate rows), and empty user or assistant rows are
inserted anywhere (I, 3). A truncated row that stays costs 3 more. The cheapest edits win, and of these
the ones whose initials, in order, are least in ASCII.

The grammar is in Chomsky normal form. Its nonterminals are pairs of places (p, q): before the system turn, after
it, within a pair, after a pair. ``(p, q) -> (p, r) (r, q)``, and ``(p, q)`` derives a row where one of the
row's edits leads from p to q. A cell holds, for a span of rows and each nonterminal, the least (cost, audit).
Insertions derive no row, so they are a closure: the cell of the empty span is composed to both sides of every
row's cell. Spans are combined bottom-up by their length. As the cells compose associatively, a table needs
no more than ``SPAN`` items: the cell of eight rows is one item of the next table, and so on, so the work is
linear in the rows. (Of two audits of equal cost over the same rows and places, neither begins with the
other, as each has one letter for each row beside its insertions; so the least of a part stays least in the whole.)

Rows are classified by DataFrame functions, equal rows are counted before they are shuffled, and the parse sees
narrow rows only, sorted, as a stream. The texts follow in a second shuffle, behind their conversation's audit,
so that a task holds one audit and one text, however long the conversation. An audit has a letter for each
row and the digest of a conversation is sequential: those of one conversation are made by one task.

Defined results: a null role or text is one space, and so is a null id or turn in ``damage``'s key; rows with a null
conversation id are one conversation; rows of equal turns are ordered by role and by SHA-256 of the
text; a role's initial is its first character, and one that is none of s, u, a cannot be kept; a conversation without
rows left has zeros and an empty audit; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import slices

# Items of one CYK table.
SPAN = 8
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_SLICE_BYTES = 1 << 20

# Places between rows: at the begin, after the system turn, after a user turn, after a pair.
BEGIN, SYSTEM, OPEN, CLOSED = range(4)
MOVES = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): OPEN, (SYSTEM, "u"): OPEN, (OPEN, "a"): CLOSED, (CLOSED, "u"): OPEN}
NAMES = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}

Cell = dict[tuple[int, int], tuple[int, str]]


def _compose(left: Cell, right: Cell) -> Cell:
    """The least derivations of a span from those of its two parts."""
    found: Cell = {}
    for (p, r), (cost, audit) in left.items():
        for (r2, q), (more, rest) in right.items():
            if r == r2:
                new = (cost + more, audit + rest)
                if (p, q) not in found or new < found[p, q]:
                    found[p, q] = new
    return found


def _closure() -> Cell:
    """The cell of no rows: chains of insertions, the shortest for each pair of places."""
    found: Cell = {(p, p): (0, "") for p in range(4)}
    steps: Cell = {(p, q): (INSERT_COST, INSERT) for (p, role), q in MOVES.items() if role in NAMES}
    while (longer := {**_compose(found, steps), **found}) != found:
        found = longer
    return found


INSERTIONS = _closure()


@lru_cache(maxsize=64)
def row_cell(symbol: str) -> Cell:
    """The cell of one row. Symbol: the role's initial, upper case if truncated; ``-`` for a row that must go."""
    found: Cell = {(p, p): (DELETE_COST, DELETE) for p in range(4)}
    if symbol != "-":
        own = symbol.lower()
        extra = TRUNCATED_COST if symbol != own else 0
        for (p, role), q in MOVES.items():
            edits = [(extra, KEEP)] if role == own else []
            edits += [(REROLE_COST + extra, REROLE)] if role in NAMES else []
            if edits:
                found[p, q] = min(edits)
    return _compose(_compose(INSERTIONS, found), INSERTIONS)


def parse(items: list[Cell]) -> Cell:
    """CYK: the cell of all items, from the cells of all shorter spans."""
    n = len(items)
    table = {(i, i + 1): cell for i, cell in enumerate(items)}
    for length in range(2, n + 1):
        for start in range(n - length + 1):
            end = start + length
            best: Cell = {}
            for cut in range(start + 1, end):
                for key, value in _compose(table[start, cut], table[cut, end]).items():
                    if key not in best or value < best[key]:
                        best[key] = value
            table[start, end] = best
    return table[0, n]


@lru_cache(maxsize=8192)
def _parse_symbols(symbols: str) -> Cell:
    return parse([row_cell(s) for s in symbols])


class Parser:
    """Takes a conversation's rows one by one; holds at most ``SPAN`` cells of each level of spans."""

    def __init__(self) -> None:
        self.symbols: list[str] = []
        self.levels: list[list[Cell]] = []

    def add(self, symbol: str) -> None:
        self.symbols.append(symbol)
        if len(self.symbols) == SPAN:
            self._push(0, _parse_symbols("".join(self.symbols)))
            self.symbols = []

    def _push(self, level: int, cell: Cell) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(cell)
        if len(self.levels[level]) == SPAN:
            whole = parse(self.levels[level])
            self.levels[level] = []
            self._push(level + 1, whole)

    def result(self) -> tuple[int, str]:
        """Least cost and audit of all rows."""
        whole = INSERTIONS
        for cells in reversed(self.levels):
            if cells:
                whole = _compose(whole, parse(cells))
        if self.symbols:
            whole = _compose(whole, _parse_symbols("".join(self.symbols)))
        return min(whole[key] for key in ((BEGIN, BEGIN), (BEGIN, CLOSED)) if key in whole)


def symbol_of(initial: str, truncated: bool) -> str:
    if initial not in ("s", "u", "a"):
        initial = "x"
    return initial.upper() if truncated else initial


class Repair:
    """Follows an audit along the rows: gives the rows that replace each row, and what is inserted after the last."""

    def __init__(self, audit: str):
        self.audit, self.at, self.place = audit, 0, BEGIN

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.at += 1
            yield self._next_name(), ""

    def _next_name(self) -> str:
        initial = "a" if self.place == OPEN else "u"
        self.place = MOVES[self.place, initial]
        return NAMES[initial]

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == KEEP:
            self.place = MOVES[self.place, role[:1]]
            yield role, text
        elif letter == REROLE:
            yield self._next_name(), text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._inserted()


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` and ``copies`` of every row, damaged by the hash of its id and turn.

    Of twenty hashes one drops the row (``copies`` 0), one empties its text, one removes ``.!?``, one repeats the row
    (``copies`` 2), and one makes it the user's. Copies are counted, not made.
    """
    named = _columns(rows, id_col, turn_col, role_col, text_col)
    key = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c else F.lit(":") for c in ("conv", "", "turn")])
    case = F.crc32(key.cast("binary")) % 20
    return named.select(
        "conv",
        "turn",
        F.when(case == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(case == 1, "").when(case == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(case == 0, 0).when(case == 3, 2).otherwise(1).alias("copies"),
    )


def _columns(rows: DataFrame, *names: str) -> DataFrame:
    conv, turn, role, text = (F.col("`" + n.replace("`", "``") + "`") for n in names)
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    return rows.select(conv.alias("conv"), turn.alias("turn"), blank(role).alias("role"), blank(text).alias("text"))


def whole_rows(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows of a table as they are, in the columns that ``diagnose`` and ``repair`` take."""
    return _columns(rows, id_col, turn_col, role_col, text_col).withColumn("copies", F.lit(1))


_FINDINGS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def diagnose(rows: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, first faults, illegal neighbours, least cost and audit.

    Takes the columns of ``damage``. Shuffles no text: rows are counted by conversation, turn, role and digest first, then
    the earliest of equal rows is marked, then each conversation is parsed as a stream in the order of its turns.
    """
    alive = F.col("copies") > 0
    rest = F.rtrim(F.col("text"), F.lit(WHITE))
    narrow = rows.select(
        "conv",
        F.when(alive, F.col("turn")).alias("turn"),
        F.when(alive, F.col("role")).otherwise("").alias("role"),
        F.when(alive, F.unhex(F.sha2("text", 256))).alias("digest"),
        F.when(alive, rest == "").otherwise(False).alias("is_blank"),
        F.when(alive, ~F.right(rest, F.lit(1)).isin(".", "!", "?")).otherwise(False).alias("cut"),
        "copies",
    )
    counted = narrow.groupBy("conv", "turn", "role", "digest", "is_blank", "cut").agg(F.sum("copies").cast("long").alias("n"))
    earlier = Window.partitionBy("conv", "role", "digest").orderBy(F.asc_nulls_first("turn"))
    marked = counted.withColumn("is_first", F.row_number().over(earlier) == 1)
    turn = F.col("turn").cast("decimal(38,0)")
    marked = marked.select("conv", "turn", "digest", "is_first", "role", "is_blank", "cut", "n", turn.alias("number"))
    dealt = marked.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "digest")
    streamed = dealt.select("conv", F.substring("role", 1, 1).alias("initial"), "is_first", "is_blank", "cut", "n", "number")
    kind = rows.schema["conv"].dataType.simpleString()
    return streamed.mapInArrow(_diagnoses, f"conv {kind}, {_FINDINGS}")


class _Findings:
    """What the rows of one conversation add up to, in their order."""

    def __init__(self) -> None:
        self.parser, self.last, self.turn = Parser(), None, None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, initial: str, is_first: bool, is_blank: bool, cut: bool, n: int, turn: int | None) -> None:
        if not n:
            return
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += self.turn != turn
            self.turn = self.high = turn
        for i in range(n):
            if self.last is not None and self.last + initial not in _LEGAL:
                self.illegal += 1
            self.last = initial
            if is_blank:
                self.blank += 1
            elif i or not is_first:
                self.duplicate += 1
            else:
                self.truncated += cut
                self.parser.add(symbol_of(initial, cut))
                continue
            self.parser.add("-")

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return int(gaps), self.blank, self.duplicate, self.truncated, self.illegal, *self.parser.result()


def _diagnoses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, findings, kind = None, None, None
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = [*[pa.int64()] * 6, pa.string()]

    def table(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], kind), *[pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]], names
        )

    for batch in batches:
        kind, done = batch.schema.types[0], []
        for own, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if findings is None or own != conv:
                if findings is not None:
                    done.append((conv, *findings.row()))
                conv, findings = own, _Findings()
            findings.add(*row)
        if done:
            yield table(done)
    if findings is not None:
        yield table([(conv, *findings.row())])


def _behind_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation in their order, after one that carries its findings."""
    keys = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    turn, text = rows.schema["turn"].dataType, "string"
    heads = found.select(
        "conv", F.lit(None).cast(turn).alias("turn"), F.lit(None).cast(text).alias("role"), F.lit(None).cast("binary").alias("digest"),
        F.lit(None).cast(text).alias("text"), F.lit(0).alias("n"), *keys,
    )
    bodies = rows.filter("copies > 0").select(
        "conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), "text", F.col("copies").alias("n"),
        *[F.lit(None).cast(found.schema[k].dataType).alias(k) for k in keys],
    )
    both = heads.unionByName(bodies).repartition("conv")
    ordered = both.sortWithinPartitions("conv", F.col("n") != 0, F.asc_nulls_first("turn"), "role", "digest")
    return ordered.select("conv", "text", "role", "n", *keys)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Events of a stream of ``_behind_audits``: a head row, or a repaired row (role, text)."""
    repair = None
    for batch in slices(batches, "text", _SLICE_BYTES):
        for conv, text, role, n, *head in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if not n:
                if repair is not None:
                    for row in repair.end():
                        yield None, row
                repair = Repair(head[-1])
                yield (conv, *head), None
                continue
            for _ in range(n):
                for row in repair.row(role, text):
                    yield None, row
        yield None, None  # the end of a slice
    if repair is not None:
        for row in repair.end():
            yield None, row


def repaired_digests(rows: DataFrame) -> DataFrame:
    """``diagnose`` and the SHA-256 of each repaired conversation: ``role:text``, joined by line breaks. Runs a job."""
    found = cut_lineage(diagnose(rows))
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, digest, begun, done = None, None, False, []
        seen: list[pa.DataType] = []

        def first(inner):
            for batch in inner:
                seen[:] = batch.schema.types[:1]
                yield batch

        def table() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            types = [seen[0], *[pa.int64()] * 6, pa.string(), pa.string()]
            names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for new, row in _repaired(first(batches)):
            if new is not None:
                if head is not None:
                    done.append((*head, digest.hexdigest()))
                head, digest, begun = new, hashlib.sha256(), False
            elif row is not None:
                digest.update(("\n" * begun + f"{row[0]}:{row[1]}").encode())
                begun = True
            elif done:
                yield table()
                done = []
        if head is not None:
            done.append((*head, digest.hexdigest()))
        if done:
            yield table()

    return _behind_audits(rows, found).mapInArrow(run, f"conv {kind}, {_FINDINGS}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """The rows of the repaired conversations: ``conv``, ``turn`` (from 0), ``role``, ``text``. Runs a job."""
    found = cut_lineage(diagnose(rows))
    kind = rows.schema["conv"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, turn, done = None, 0, []
        seen: list[pa.DataType] = []

        def first(inner):
            for batch in inner:
                seen[:] = batch.schema.types[:1]
                yield batch

        def table() -> pa.RecordBatch:
            columns = zip(*done, strict=True)
            types = [seen[0], pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv", "turn", "role", "text"]
            )

        for new, row in _repaired(first(batches)):
            if new is not None:
                conv, turn = new[0], 0
            elif row is not None:
                done.append((conv, turn, *row))
                turn += 1
            elif done:
                yield table()
                done = []
        if done:
            yield table()

    return _behind_audits(rows, found).mapInArrow(run, f"conv {kind}, turn long, role string, text string")


def _oracle() -> str:
    """The contract in SQL: a shortest path over the four places, row after row, in a recursive query."""
    halved = "lambda z, i: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END"
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    codes = f"list_transform(string_split({key}, ''), lambda x: ascii(x)::BIGINT)"
    crc = f"xor(list_reduce({codes}, lambda c, b: list_reduce(range(8), {halved}, xor(c, b)), 4294967295::BIGINT), 4294967295)"
    moves = sorted(MOVES.items())

    def least(options: list[str]) -> str:
        return f"list_min(list_filter([{', '.join(options)}], lambda x: x.c IS NOT NULL))"

    def after(old: str, cost: str, letter: str, lines: str) -> str:
        return f"{{'c': ({old}.c + {cost})::BIGINT, 'a': {old}.a || '{letter}', 'o': {old}.o || {lines}}}"

    def inserted(source: str) -> str:
        """At most one insertion more, for every place."""
        cells = []
        for place in range(4):
            options = [f"{source}.s{place}"]
            for (p, role), q in moves:
                if q == place and role in NAMES:
                    options.append(after(f"{source}.s{p}", str(INSERT_COST), INSERT, f"['{NAMES[role]}:']"))
            cells.append(f"{least(options)} AS s{place}")
        return ", ".join(cells)

    extra = f"CASE WHEN f = 'truncated' THEN {TRUNCATED_COST} ELSE 0 END"
    cells = []
    for place in range(4):
        options = [after(f"y.s{place}", str(DELETE_COST), DELETE, "[]::VARCHAR[]")]
        for (p, role), q in moves:
            if q == place:
                kept = f"CASE WHEN f IN ('ok', 'truncated') AND left(role, 1) = '{role}' THEN {extra} END"
                options.append(after(f"y.s{p}", kept, KEEP, "[role || ':' || text]"))
                if role in NAMES:
                    moved = f"CASE WHEN f IN ('ok', 'truncated') THEN {REROLE_COST} + {extra} END"
                    options.append(after(f"y.s{p}", moved, REROLE, f"['{NAMES[role]}:' || text]"))
        cells.append(f"{least(options)} AS s{place}")
    none = "{'c': NULL::BIGINT, 'a': NULL::VARCHAR, 'o': NULL::VARCHAR[]}"
    start = ", ".join(["{'c': 0::BIGINT, 'a': '', 'o': []::VARCHAR[]} AS s0", *[f"{none} AS s{q}" for q in range(1, 4)]])
    white = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS d FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN replace(replace(replace(text, '.', ''), '!', ''), '?', '') ELSE text END AS text,
    unnest(range(CASE WHEN d = 0 THEN 0 WHEN d = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed),
placed AS (
  SELECT *, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before, rtrim(text, {white}) AS rest,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again
  FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy)),
judged AS MATERIALIZED (
  SELECT *, CASE WHEN rest = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
    WHEN right(rest, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'ok' END AS f FROM placed),
walk(conv_id, i, s0, s1, s2, s3) AS (
  SELECT conv_id, 0::BIGINT, {inserted("z")} FROM (SELECT conv_id, {inserted("y")} FROM (
    SELECT DISTINCT conv_id, {start} FROM conversations) y) z
  UNION ALL
  SELECT conv_id, i, {inserted("z")} FROM (SELECT conv_id, i, {inserted("x")} FROM (
    SELECT y.conv_id, j.i, {", ".join(cells)}
    FROM walk y JOIN judged j ON j.conv_id IS NOT DISTINCT FROM y.conv_id AND j.i = y.i + 1) x) z),
final AS (
  SELECT conv_id, arg_max(list_min(list_filter([s0, s3], lambda x: x.c IS NOT NULL)), i) AS best FROM walk GROUP BY conv_id),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate, count(*) FILTER (f = 'truncated') AS truncated,
    count(*) FILTER (before || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv_id)
SELECT w.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.c AS cost, best.a AS audit,
  sha256(array_to_string(best.o, chr(10))) AS repaired_sha256
FROM final w LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id"""


ORACLE = _oracle()
