"""Repair of conversations whose turns are lost, repeated, empty, cut or given to the wrong role.

The rows of a conversation, in the order of their turns, are edited until the first letters of their
roles read ``(s?(ua)+)?``. Each edit has a letter and a cost: D deletes a row (2), I inserts an empty
row of user or assistant (5), K keeps a row (0), R gives a row to user or assistant (1). Blank rows and
rows whose role and text were seen earlier have to go; a row that is cut off in mid-sentence and stays
costs 5 more. Wanted is the cheapest list of edits, and of several the one whose letters, in the order
of the rows, come first in ASCII.

Search is iterative-deepening A*: depth first, edits in ASCII order, under a bound on the cost that
rises to the least cost by which the last round exceeded it. A table of failed states (row, state of
the pattern) keeps the least remaining cost each has been shown to need, across rounds; a state is
not entered with less. Every state has one role that fits, so the first path that is accepted is the
answer, its letters being the least in ASCII.

A conversation may hold a third of all rows, so the search runs on blocks of ``BLOCK`` rows, for
each state of the pattern a block may begin and end in. A block ends with the edit of its last row,
and inserts belong to the row after them (behind the last row of all, to that one); hence no list of
edits of a block begins another one, and the least whole list is made of least lists of its blocks.
The costs of up to ``FAN`` neighbouring blocks are put together to those of a larger block, and so on
until a conversation has at most ``FAN``; the choice then goes down the same way. Rows are numbered by
one range sort; no task gathers a conversation. Only the digest of a conversation's text reads its
rows one after the other in one task, as a stream, because SHA-256 cannot be put together from parts.

Order: turn, nulls first; rows of one turn by role, the first 64 characters of the text and its digest.
Nulls in role and text read as one space (so a null text is blank, and a null role never fits). Rows with
a null conv_id are one conversation. A role with an empty name never fits. Repeated rows are rows of
their own. Other columns of the table play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbside.llm.common import Steps, let_workers_import
from kerbside.operators.numbering import number_rows
from kerbside.storage import intermediate_tables

BLOCK = 32
FAN = 64
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5

#: States of the pattern: nothing yet, after the system row, after a user row, after an assistant row.
STATES = 4
ENDS = 5  # the four states, and "accepted"
ACCEPTED = 4
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_NEXT = (2, 2, 3, 2)  # the state after the role that fits
_NEVER = 1 << 60
_FOUND = -1

_SPACES = " \t\n\x0b\x0c\r"
_SOUND, _GONE, _CUT = 0, 1, 2  # kinds of rows: fine or not, has to go, cut off
_INITIALS = "suax"


def row_code(initial: str, kind: int) -> str:
    """One letter for what the search knows of a row."""
    return chr(65 + 3 * _INITIALS.index(initial if initial in ("s", "u", "a") else "x") + kind)


@lru_cache(maxsize=1 << 16)
def cheapest(rows: str, start: int, end: int) -> tuple[int, str] | None:
    """Cost and edits that lead from a state before the rows to one after them, None if none do.

    Edits are D, K, U and A (rerole to user, assistant), u and a (insert one). After the last row
    only the end ``ACCEPTED`` allows inserts.
    """
    known = [divmod(ord(code) - 65, 3) for code in rows]
    n = len(known)
    floor = [0] * (n + 1)  # every faulty row that is left costs its deletion at least
    for i in range(n - 1, -1, -1):
        floor[i] = floor[i + 1] + (DELETE if known[i][1] else 0)
    failed: dict[tuple[int, int], int] = {}
    path: list[str] = []

    def visit(i: int, state: int, left: int) -> int:
        """_FOUND, or a bound above ``left`` on the cost from here."""
        if i == n:
            if state == end or (end == ACCEPTED and state in (0, 3)):
                return _FOUND
            if end != ACCEPTED:
                return _NEVER
        if end < 2 and state > end:
            return _NEVER
        need = failed.get((i, state), floor[i])
        if need > left:
            return need
        fits = _NEXT[state]
        user = fits == 2
        moves = [(INSERT, "u" if user else "a", i, fits)]
        if i < n:
            initial, kind = known[i]
            moves.insert(0, (DELETE, "D", i + 1, state))
            if kind != _GONE:
                more = CUT_OFF if kind == _CUT else 0
                kept = _KEPT.get((state, _INITIALS[initial]))
                if kept is not None:
                    moves.append((more, "K", i + 1, kept))
                moves.append((more + REROLE, "U" if user else "A", i + 1, fits))
        least = _NEVER
        for cost, letter, row, then in moves:
            rest = visit(row, then, left - cost) if cost <= left else floor[row]
            if rest == _FOUND:
                path.append(letter)
                return _FOUND
            least = min(least, cost + rest)
        failed[(i, state)] = least
        return least

    bound = floor[0]
    while True:
        exceeded = visit(0, start, bound)
        if exceeded == _FOUND:
            return bound, "".join(reversed(path))
        if exceeded >= _NEVER:
            return None
        bound = exceeded


def letters(edits: str) -> str:
    return edits.translate(str.maketrans("UAua", "RRII"))


def _ranks(options: list) -> list[int]:
    """Places among the options of one start, by what is compared; -1 for None."""
    ranks = [-1] * len(options)
    for first in range(0, len(options), ENDS):
        have = [i for i in range(first, min(first + ENDS, len(options))) if options[i] is not None]
        for place, i in enumerate(sorted(have, key=lambda i: options[i])):
            ranks[i] = place
    return ranks


def block_options(rows: str, first: bool, last: bool) -> tuple[list[int], list[int], list[str]]:
    """Costs, ranks and edits of a block for each (start, end); cost -1 where there are none."""
    costs, edits = [-1] * (STATES * ENDS), [""] * (STATES * ENDS)
    for start in (0,) if first else range(STATES):
        for end in (ACCEPTED,) if last else range(STATES):
            found = cheapest(rows, start, end)
            if found is not None:
                costs[start * ENDS + end], edits[start * ENDS + end] = found
    compared = [letters(e) if c >= 0 else None for c, e in zip(costs, edits)]
    return costs, _ranks(compared), edits


def folded(costs: list[list[int]], ranks: list[list[int]]) -> tuple[list[int], list[int], list[list[int]]]:
    """Options of several blocks as one: costs, ranks, and the option chosen of each block."""
    n = len(costs)
    out_costs, out_paths, compared = [], [], []
    for option in range(STATES * ENDS):
        start, end = divmod(option, ENDS)
        # the cheapest way from each state before block k to the end
        togo = [[_NEVER] * ENDS for _ in range(n + 1)]
        togo[n][end] = 0
        for k in range(n - 1, -1, -1):
            for state in range(STATES):
                togo[k][state] = min(
                    (
                        costs[k][state * ENDS + then] + togo[k + 1][then]
                        for then in range(ENDS)
                        if costs[k][state * ENDS + then] >= 0
                    ),
                    default=_NEVER,
                )
        if togo[0][start] >= _NEVER:
            out_costs.append(-1)
            out_paths.append([])
            compared.append(None)
            continue
        state, path = start, []
        for k in range(n):
            own = costs[k]
            best = [
                state * ENDS + then
                for then in range(ENDS)
                if own[state * ENDS + then] >= 0
                and own[state * ENDS + then] + togo[k + 1][then] == togo[k][state]
            ]
            path.append(min(best, key=lambda o: ranks[k][o]))
            state = path[-1] % ENDS
        out_costs.append(togo[0][start])
        out_paths.append(path)
        compared.append([ranks[k][o] for k, o in enumerate(path)])
    return out_costs, _ranks(compared), out_paths


def damaged(rows: DataFrame) -> DataFrame:
    """What is left of the rows after faults chosen by the crc32 of ``conv_id:turn``."""
    one_space = F.lit(" ")
    name = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), one_space),
        F.lit(":"),
        F.coalesce(F.col("turn").cast("string"), one_space),
    )
    text = F.coalesce("text", one_space)
    return (
        rows.select("conv_id", "turn", "role", "text", (F.crc32(name.cast("binary")) % 20).alias("fault"))
        .filter("fault <> 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("fault") == 4, "user").otherwise(F.coalesce("role", one_space)).alias("role"),
            F.when(F.col("fault") == 1, "")
            .when(F.col("fault") == 2, F.translate(text, ".!?", ""))
            .otherwise(text)
            .alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


_ROW = ["conv", "turn", "role", "digest"]


def _keyed(rows: DataFrame) -> DataFrame:
    one_space = F.lit(" ")
    text = F.coalesce("text", one_space)
    return rows.select(
        F.struct("conv_id").alias("conv"),  # as a field, a null id equals itself
        "turn",
        F.coalesce("role", one_space).alias("role"),
        text.alias("text"),
        F.sha2(text, 256).alias("digest"),
    )


def _code(initial: Column, kind: Column) -> Column:
    place = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(65 + 3 * place + kind)


def _numbered(rows: DataFrame, steps: Steps, block: int) -> DataFrame:
    """conv, turn, role, digest, number n in the order of all rows, block b, and the faults."""
    end = F.substring(F.rtrim("text", F.lit(_SPACES)), -1, 1)
    slim = _keyed(rows).select(
        *_ROW,
        F.substring("text", 1, 64).alias("head"),
        (end == "").alias("blank"),
        (~end.isin(".", "!", "?")).alias("cut"),
        F.monotonically_increasing_id().alias("copy"),
    )
    with intermediate_tables(rows.sparkSession):
        order = ["conv", "turn", "role", "head", "digest"]
        numbered = number_rows(slim, order, "n", copy_column="copy").drop("head")
        first = numbered.groupBy("conv", "role", "digest").agg(F.min("n").alias("first_n"))
        blank, again = F.col("blank"), F.col("n") > F.col("first_n")
        truncated = ~blank & ~again & F.col("cut")
        kind = F.when(blank | again, _GONE).when(truncated, _CUT).otherwise(_SOUND)
        return steps.keep(
            numbered.join(first, ["conv", "role", "digest"]).select(
                *_ROW,
                "n",
                F.expr(f"n div {block}").alias("b"),
                blank.cast("long").alias("blank"),
                (~blank & again).cast("long").alias("duplicate"),
                truncated.cast("long").alias("truncated"),
                _code(F.substring("role", 1, 1), kind).alias("code"),
            ),
            "turns_rows",
        )


def _per_conversation(rows: DataFrame) -> DataFrame:
    return rows.groupBy("conv").agg(
        F.min("n").alias("first_n"),
        F.max("n").alias("last_n"),
        F.coalesce(
            F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)
        ).cast("long").alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")),
    )


def _most_nodes(conversations: DataFrame, size: int) -> int:
    """The largest number of blocks of ``size`` rows that a conversation lies in."""
    spans = F.expr(f"last_n div {size} - first_n div {size} + 1")
    return conversations.agg(F.max(spans)).first()[0] or 0


_NODE = "costs array<long>, ranks array<int>, head string, tail string, illegal long"


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _blocks(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per conversation and block of rows: its options, its first row n and its edits."""
    held = (
        rows.groupBy("conv", "b")
        .agg(
            F.min("n").alias("from_n"),
            F.max("n").alias("to_n"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "code"))), lambda r: r["code"]), "")
            .alias("codes"),
        )
        .join(conversations.select("conv", "first_n", "last_n"), "conv")
        .select(
            "conv", "b", "from_n", "codes",
            (F.col("from_n") == F.col("first_n")).alias("first"),
            (F.col("to_n") == F.col("last_n")).alias("last"),
        )
    )

    def search(batches):
        for batch in batches:
            options, ends = [], []
            for codes, first, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "first", "last"))):
                options.append(block_options(codes, first, last))
                initials = [_INITIALS[(ord(c) - 65) // 3] for c in codes]
                ends.append((initials[0], initials[-1], _illegal(initials)))
            costs, ranks, edits = zip(*options) if options else ((), (), ())
            heads, tails, illegal = zip(*ends) if ends else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv", "b", "from_n")),
                    pa.array(costs, pa.list_(pa.int64())),
                    pa.array(ranks, pa.list_(pa.int32())),
                    pa.array(heads, pa.string()),
                    pa.array(tails, pa.string()),
                    pa.array(illegal, pa.int64()),
                    pa.array(edits, pa.list_(pa.string())),
                ],
                names=["conv", "b", "from_n", "costs", "ranks", "head", "tail", "illegal", "edits"],
            )

    return held.mapInArrow(search, _schema(held, "conv", "b", "from_n", f"{_NODE}, edits array<string>"))


def _schema(df: DataFrame, *parts: str) -> T.StructType:
    """Columns of ``df`` by name, and then the columns that the last part declares."""
    *names, declared = parts
    return T.StructType([df.schema[n] for n in names] + T._parse_datatype_string(declared).fields)


def _folded_blocks(nodes: DataFrame, fan: int | None) -> DataFrame:
    """Up to ``fan`` neighbouring nodes as one (None: all nodes of a conversation), with ``kids``, their
    numbers, and ``paths``, the options to choose of them for each option of the whole."""
    above = F.expr(f"b div {fan}") if fan else F.lit(0).cast("long")
    held = nodes.groupBy("conv", above.alias("b")).agg(
        F.array_sort(
            F.collect_list(
                F.struct(F.col("b").alias("kid"), "costs", "ranks", "head", "tail", "illegal")
            )
        ).alias("kids")
    )

    def fold(batches):
        for batch in batches:
            rows = []
            for kids in batch.column("kids").to_pylist():
                costs, ranks, paths = folded([k["costs"] for k in kids], [k["ranks"] for k in kids])
                between = sum(_illegal([a["tail"], b["head"]]) for a, b in zip(kids, kids[1:]))
                rows.append(
                    (
                        costs, ranks, kids[0]["head"], kids[-1]["tail"],
                        between + sum(k["illegal"] for k in kids), [k["kid"] for k in kids], paths,
                    )
                )
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [
                pa.list_(pa.int64()), pa.list_(pa.int32()), pa.string(), pa.string(), pa.int64(),
                pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("b"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=["conv", "b", "costs", "ranks", "head", "tail", "illegal", "kids", "paths"],
            )

    return held.mapInArrow(
        fold, _schema(held, "conv", "b", f"{_NODE}, kids array<long>, paths array<array<int>>")
    )


def _choices(picked: DataFrame, nodes: DataFrame) -> DataFrame:
    """From options picked of nodes (conv, b, pick) to those of the nodes below them."""
    path = F.element_at("paths", F.col("pick") + 1)
    return (
        picked.join(nodes.select("conv", "b", "kids", "paths"), ["conv", "b"])
        .select("conv", F.explode(F.arrays_zip(F.col("kids").alias("kid"), path.alias("option"))).alias("k"))
        .select("conv", F.col("k.kid").alias("b"), F.col("k.option").alias("pick"))
    )


class Repair:
    """The repair of a table of conversations (conv_id, turn, role, text).

    ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    ``rows()``: the repaired rows. Tables in the shared folder stay until the application's end.
    """

    def __init__(self, rows: DataFrame, block: int = BLOCK, fan: int = FAN):
        self._steps = steps = Steps(rows.sparkSession)
        let_workers_import(rows.sparkSession)
        self._texts = rows
        self._rows = _numbered(rows, steps, block)
        per_conversation = steps.keep(_per_conversation(self._rows), "turns_conversations")
        blocks = steps.keep(_blocks(self._rows, per_conversation), "turns_blocks")
        levels, size = [blocks], block
        while _most_nodes(per_conversation, size) > fan:
            levels.append(steps.keep(_folded_blocks(levels[-1], fan), f"turns_level_{len(levels)}"))
            size *= fan
        top = steps.keep(_folded_blocks(levels[-1], None), "turns_top")
        picked = top.select("conv", "b", F.lit(ACCEPTED).alias("pick"))  # from state 0
        for nodes in [top, *reversed(levels[1:])]:
            picked = _choices(picked, nodes)
        edits = F.element_at("edits", F.col("pick") + 1)
        self._edits = steps.keep(
            picked.join(blocks, ["conv", "b"]).select("conv", "b", "from_n", edits.alias("edits")), "turns_edits"
        )
        audits = self._edits.groupBy("conv").agg(
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("b", "edits"))), lambda r: r["edits"]), ""
            ).alias("edits")
        )
        self.conversations = (
            per_conversation.join(
                top.select("conv", F.element_at("costs", ACCEPTED + 1).alias("cost"), "illegal"), "conv"
            )
            .join(audits, "conv")
            .select(
                F.col("conv.conv_id").alias("conv_id"),
                "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                F.translate("edits", "UAua", "RRII").alias("audit"),
            )
        )

    def rows(self) -> DataFrame:
        """conv_id, n (number of the row it comes from or is inserted at), place there, role, text."""
        own = F.element_at(
            F.regexp_extract_all("edits", F.lit("[ua]*[DKUA]"), F.lit(0)), (F.col("n") - F.col("from_n") + 1).cast("int")
        )
        # inserts behind the last row of all belong to it
        behind = F.when(
            F.col("n") - F.col("from_n") + 1 == F.length(F.translate("edits", "ua", "")),
            F.regexp_extract("edits", "[ua]*$", 0),
        ).otherwise("")
        edited = self._rows.join(self._edits, ["conv", "b"]).select(
            *_ROW, "n", F.concat(own, behind).alias("edits")
        )
        texts = _keyed(self._texts).dropDuplicates(_ROW)
        on = [F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) for c in _ROW]
        edit, role = F.col("edit"), F.col("e.role")
        return (
            edited.alias("e")
            .join(texts.alias("t"), on)
            .select(
                F.col("e.conv.conv_id").alias("conv_id"),
                F.col("e.n").alias("n"),
                role.alias("role"),
                F.col("t.text").alias("text"),
                F.posexplode(F.split(F.col("e.edits"), "")).alias("place", "edit"),
            )
            .filter(edit.isin("K", "U", "A", "u", "a"))
            .select(
                "conv_id",
                "n",
                "place",
                F.when(edit == "K", F.col("role"))
                .when(edit.isin("U", "u"), "user")
                .otherwise("assistant")
                .alias("role"),
                F.when(edit.isin("u", "a"), "").otherwise(F.col("text")).alias("text"),
            )
        )


def text_digests(rows: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its ``role:text`` lines, joined by newlines, in order of (n, place).

    Rows pass through a task as a stream, whatever the length of a conversation."""
    sorted_rows = (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "n", "place")
        .select("conv_id", F.concat("role", F.lit(":"), "text").alias("line"))
    )
    schema = _schema(sorted_rows, "conv_id", "sha256 string")
    kind = pa.string()

    def digest(batches) -> Iterator[pa.RecordBatch]:
        now, running, id_type = None, None, None

        def closed(ids, hashes):
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, id_type), pa.array(hashes, kind)], names=["conv_id", "sha256"]
            )

        for batch in batches:
            id_type = batch.column("conv_id").type
            ids, hashes = [], []
            for place, conv in enumerate(batch.column("conv_id").to_pylist()):
                line = batch.column("line")[place].as_py().encode()
                if running is None or conv != now:
                    if running is not None:
                        ids.append(now)
                        hashes.append(running.hexdigest())
                    now, running = conv, hashlib.sha256(line)
                else:
                    running.update(b"\n")
                    running.update(line)
            yield closed(ids, hashes)
        if running is not None:
            yield closed([now], [running.hexdigest()])

    return sorted_rows.mapInArrow(digest, schema)


def repair_digests(conversations: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Damages the rows, repairs them, and gives one row for every conv_id of the table, with the
    SHA-256 of its repaired text; a conversation without any row left has zeros and empty values."""
    repair = Repair(damaged(conversations), block, fan)
    nothing = hashlib.sha256(b"").hexdigest()
    every = conversations.select("conv_id").distinct().alias("c")
    found, texts = repair.conversations.alias("r"), text_digests(repair.rows()).alias("d")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return (
        every.join(found, F.col("c.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
        .join(texts, F.col("c.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
        .select(
            "c.conv_id",
            *(F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long").alias(c) for c in counts),
            F.coalesce("r.audit", F.lit("")).alias("audit"),
            F.coalesce("d.sha256", F.lit(nothing)).alias("repaired_sha256"),
        )
    )
