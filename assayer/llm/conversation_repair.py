"""Cheapest edits that give a conversation an order of roles that alternates, decided by one integer minimum.

An order is whole if the initials of its roles read ``(s?(ua)+)?``. Keeping a row costs nothing, a new role 3, a
removal 4, an inserted row 3, and a row that stays cut off 3 more; blank and repeated rows must go. A path of
edits is one integer: its high digits are the cost, the digits below it, at their place from the left and padded
with zeros at the end, are the letters of the edits. The smallest integer is the cheapest path, and of the
cheapest the one whose letters come first.

Conversations can be of any length. Rows are sorted by range, so one conversation spans many tasks, and its rows
are searched in blocks of ``BLOCK``: the search of a block gives the smallest integer for each state before it and
after it. Two paths through the same rows of a block differ before either ends, so the order of the letters within
the blocks is that of the whole, and per conversation only 16 costs and ranks per block come together.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.llm.frames import columns_of, if_small, small_batches, staged, with_row_ids

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3  # fixed costs
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}  # digits in the order of the letters; 0 is the end
_LETTER = {digit: letter for letter, digit in LETTERS.items()}
_BITS = 3  # of a digit

#: States: nothing yet, after system, after user, after assistant. A user is due in all but the third.
_STATES = range(4)
_DUE = (2, 2, 3, 2)
_KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
_ROLE = {2: "user", 3: "assistant"}
_END = ("", "II", "I", "")  # inserted after the last row, by state
_LEGAL = {"su", "ua", "au"}

#: Rows of a conversation that are searched together; a power of two.
BLOCK_BITS = 12
_SPACES = " \t\n\x0b\f\r"
_LAST = 2**63 - 1


def block_paths(codes: str) -> list[list[tuple[int, str] | None]]:
    """For each state before and after some rows, cost and letters of the smallest path, or None.

    ``codes`` has two characters per row: the initial of its role, and ``d`` (must go), ``t`` (cut off) or ``.``.
    Rows are inserted before a row, never after the last.
    """
    n = len(codes) // 2
    width = _BITS * 3 * max(n, 1)  # at most two insertions before a row
    digits = (1 << width) - 1
    never = 1 << (width + 50)

    def step(letter: str, cost: int, rest: int) -> int:
        # The letters of the rest move one place to the right; the last place is still padding.
        return rest - (rest & digits) + (cost << width) + (LETTERS[letter] << (width - _BITS)) + ((rest & digits) >> _BITS)

    paths = []
    for after in _STATES:
        value = [0 if state == after else never for state in _STATES]
        for i in range(2 * n - 2, -2, -2):
            kept = _KEPT.get(codes[i], (None,) * 4)
            fault = codes[i + 1]
            extra = CUT_OFF if fault == "t" else 0
            plain = []
            for state in _STATES:
                edges = [step("D", DELETE, value[state])]
                if fault != "d":
                    edges.append(step("R", REROLE + extra, value[_DUE[state]]))
                    if kept[state] is not None:
                        edges.append(step("K", KEEP + extra, value[kept[state]]))
                plain.append(min(edges))
            # More than two insertions in one place come back to a state that fewer reach.
            once = [min(plain[s], step("I", INSERT, plain[_DUE[s]])) for s in _STATES]
            value = [min(plain[s], step("I", INSERT, once[_DUE[s]])) for s in _STATES]
        paths.append(value)
    return [[_read(paths[after][state], width, never) for after in _STATES] for state in _STATES]


def _read(value: int, width: int, never: int) -> tuple[int, str] | None:
    if value >= never:
        return None
    letters, place = [], width
    while place and (digit := value >> (place - _BITS) & 7):
        letters.append(_LETTER[digit])
        place -= _BITS
    return value >> width, "".join(letters)


def _ranks(row: list[tuple[int, str] | None]) -> list[int]:
    order = sorted((x for x in row if x is not None), key=lambda x: x[1])
    return [-1 if x is None else order.index(x) for x in row]


def whole_path(costs: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[int]]:
    """Least cost of consecutive blocks, and for each block its place (state before * 4 + state after)."""
    value = [INSERT * len(end) for end in _END]
    choices = []
    for cost, rank in zip(reversed(costs), reversed(ranks)):
        choice = []
        for state in _STATES:
            open_ = [4 * state + s for s in _STATES if rank[4 * state + s] >= 0]
            choice.append(min(open_, key=lambda at: (cost[at] + value[at % 4], rank[at]), default=None))
        value = [2**60 if at is None else cost[at] + value[at % 4] for at in choice]
        choices.append(choice)
    state, picks = 0, []
    for choice in reversed(choices):
        picks.append(choice[state])
        state = choice[state] % 4
    return value[0], picks


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, tuple] = {}
    for batch in batches:
        results = []
        for codes in batch["codes"].to_pylist():
            found = known.get(codes)
            if found is None:
                paths = block_paths(codes)
                flat = [x for row in paths for x in row]
                costs = [0 if x is None else x[0] for x in flat]
                illegal = sum(a + b not in _LEGAL for a, b in zip(codes[::2], codes[2::2]))
                found = costs, [r for row in paths for r in _ranks(row)], ["" if x is None else x[1] for x in flat], illegal
                if len(codes) <= 24 and len(known) < 20_000:  # short conversations look alike
                    known[codes] = found
            results.append(found)
        costs, ranks, letters, illegal = zip(*results) if results else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(costs, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32())),
             pa.array(letters, pa.list_(pa.string())), pa.array(illegal, pa.int64())],
            [*batch.schema.names, "costs", "ranks", "letters", "illegal"],
        )


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("block", pa.int64()), ("pick", pa.int32())]))
    for batch in batches:
        out = []
        for blocks in batch["blocks"].to_pylist():
            cost, picks = whole_path([b["costs"] for b in blocks], [b["ranks"] for b in blocks])
            joints = sum(a["last"] + b["first"] not in _LEGAL for a, b in zip(blocks, blocks[1:]))
            out.append((cost, joints, [{"block": b["block"], "pick": p} for b, p in zip(blocks, picks)]))
        cost, joints, picks = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [batch["conv_id"], pa.array(cost, pa.int64()), pa.array(joints, pa.int64()), pa.array(picks, kind)],
            ["conv_id", "cost", "joints", "picks"],
        )


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row that is not kept as it is: its letter, new role, and the roles inserted before it."""
    for batch in batches:
        out = []
        for conv, first, state, letters, codes in zip(
            batch["conv_id"], *(batch[c].to_pylist() for c in ("first_row", "state", "piece", "codes"))
        ):
            before, at = [], 0
            for letter in letters:
                if letter == "I":
                    state = _DUE[state]
                    before.append(_ROLE[state])
                    continue
                role = None
                if letter == "R":
                    state = _DUE[state]
                    role = _ROLE[state]
                elif letter == "K":
                    state = _KEPT[codes[2 * at]][state]
                if before or letter != "K":
                    out.append((conv, first + at, letter, role, before))
                before, at = [], at + 1
            if before:  # only the rows after the last one
                out.append((conv, _LAST, "D", None, before))
        cols = list(zip(*out)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array([c.as_py() for c in cols[0]], batch.schema.field("conv_id").type), pa.array(cols[1], pa.int64()),
             pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.list_(pa.string()))],
            ["conv_id", "edited_row", "letter", "new_role", "before"],
        )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash of the lines of each conversation, which come sorted and may go on in the next batch."""
    current, state = None, None
    kind = None

    def result(conv, digest):
        return pa.RecordBatch.from_arrays([pa.array(conv, kind), pa.array(digest, pa.string())], ["conv_id", "digest"])

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        convs, digests = [], []
        for conv, line in zip(batch["conv_id"].to_pylist(), batch["line"].to_pylist()):
            if state is None or conv != current:
                if state is not None:
                    convs.append(current)
                    digests.append(state.hexdigest())
                current, state = conv, sha256()
            else:
                state.update(b"\n")
            state.update(line.encode())
        yield result(convs, digests)
    if state is not None:
        yield result([current], [state.hexdigest()])


class Repair:
    """The repair of a table of conversations; its tables are staged and read by all results.

    Null texts and roles are one space. Rows are taken by turn, nulls first; rows of one turn by role, the first 32
    characters of their text, and its MD5. Rows without ``conv_id`` are one conversation. A role counts by its first
    character; a role that is empty or starts with another character than s, u or a cannot be kept. Repeated rows are
    found by role and MD5. An empty table gives empty results; other columns are ignored, whatever their names.
    """

    def __init__(self, rows: DataFrame, conv_id="conv_id", turn="turn", role="role", text="text"):
        small_batches(rows.sparkSession)
        given = columns_of(rows, conv_id=conv_id, turn=turn, role=role, text=text)
        given = given.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text")})
        # The place in the input only tells copies of one row apart, so that many of them are not one task's.
        given = given.withColumns({"md5": F.md5("text"), "head": F.left("text", F.lit(32)), "copy": F.monotonically_increasing_id() % 1024})
        keys = ["conv_id", "turn", "role", "head", "md5", "copy"]
        ordered = given.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("head", "copy")
        self.rows = staged(with_row_ids(ordered), "turns")
        self._id = self.rows.schema["conv_id"].dataType
        self._blocks = staged(self._searched(), "turn-blocks")
        self._paths = staged(self._decided(), "turn-paths")

    def faults(self) -> DataFrame:
        """row_id, conv_id, initial of the role, and fault: blank, duplicate, truncated or null."""
        rest = F.rtrim("text", F.lit(_SPACES))
        rows = self.rows.select("conv_id", "row_id", F.substring("role", 1, 1).alias("initial"), "role", "md5", (rest == "").alias("blank"),
                                F.substring(rest, -1, 1).isin(*".!?").alias("ends"))
        # Both sides of the join have one row per row: no key is hot.
        firsts = rows.filter("NOT blank").groupBy("conv_id", "role", "md5").agg(F.min("row_id").alias("first")).select("first")
        fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("ends"), "truncated")
        return rows.join(firsts, F.col("row_id") == F.col("first"), "left").select("conv_id", "row_id", "initial", fault.alias("fault"))

    def _searched(self) -> DataFrame:
        must = F.col("fault").isin("blank", "duplicate")
        code = F.concat(F.rpad("initial", 1, " "), F.when(must, "d").when(F.col("fault") == "truncated", "t").otherwise("."))
        listed = F.array_sort(F.collect_list(F.struct("row_id", code.alias("code"))))
        count = {name: F.count_if(F.col("fault") == name).alias(name) for name in ("blank", "duplicate", "truncated")}
        blocks = (
            self.faults()
            .groupBy("conv_id", F.shiftright("row_id", BLOCK_BITS).alias("block"))
            .agg(F.array_join(F.transform(listed, lambda x: x["code"]), "").alias("codes"), F.min("row_id").alias("first_row"), *count.values())
        )
        schema = T.StructType(blocks.schema.fields + T._parse_datatype_string("costs array<long>, ranks array<int>, letters array<string>, illegal long").fields)
        return blocks.mapInArrow(_search, schema)

    def _decided(self) -> DataFrame:
        codes = F.col("codes")
        initials = F.array(F.substring(codes, 1, 1).alias("first"), F.substring(codes, -2, 1))
        one = F.struct("block", "costs", "ranks", initials[0].alias("first"), initials[1].alias("last"))
        grouped = self._blocks.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("blocks"))
        schema = T.StructType([T.StructField("conv_id", self._id)] + T._parse_datatype_string("cost long, joints long, picks array<struct<block:long,pick:int>>").fields)
        return grouped.mapInArrow(_decide, schema)

    def _pieces(self) -> DataFrame:
        picks = self._paths.select(F.col("conv_id").alias("own"), F.inline("picks").alias("at", "pick"))
        same = F.col("conv_id").eqNullSafe(F.col("own")) & (F.col("block") == F.col("at"))
        piece = F.get("letters", F.col("pick")).alias("piece")
        return self._blocks.join(picks, same).select("conv_id", "block", "first_row", "codes", "pick", piece, "blank", "duplicate", "truncated", "illegal")

    def report(self) -> DataFrame:
        """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit (letters of the edits) per conversation."""
        in_order = F.array_sort(F.collect_list(F.struct("block", "piece", "pick")))
        per_conv = self._pieces().groupBy("conv_id").agg(
            *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")), in_order.alias("pieces")
        )
        end = F.element_at(F.array(*map(F.lit, _END)), F.element_at("pieces", -1)["pick"] % 4 + 1)
        audit = F.concat(F.array_join(F.transform("pieces", lambda x: x["piece"]), ""), end)
        turns = self.rows.groupBy(F.col("conv_id").alias("turn_conv")).agg(
            F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps")
        )
        paths = self._paths.select(F.col("conv_id").alias("own"), "cost", "joints")
        return (
            per_conv.join(paths, F.col("conv_id").eqNullSafe(F.col("own")))
            .join(turns, F.col("conv_id").eqNullSafe(F.col("turn_conv")))
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("joints")).cast("long").alias("illegal"), "cost", audit.alias("audit"))
        )

    def repaired(self) -> DataFrame:
        """The rows after all edits: conv_id, row_id, nth (of the rows put in with that row), role and text."""
        schema = T.StructType([T.StructField("conv_id", self._id)] + T._parse_datatype_string("edited_row long, letter string, new_role string, before array<string>").fields)
        last = self._paths.filter(F.size("picks") > 0).select(
            "conv_id", F.lit(0).cast("long").alias("first_row"), F.lit(0).alias("state"),
            F.element_at(F.array(*map(F.lit, _END)), F.element_at("picks", -1)["pick"] % 4 + 1).alias("piece"),
            F.lit("").alias("codes"), (F.element_at("picks", -1)["pick"] % 4).alias("from"),
        ).filter("piece <> ''").select("conv_id", "first_row", F.col("from").cast("int").alias("state"), "piece", "codes")
        pieces = self._pieces().select("conv_id", "first_row", F.floor(F.col("pick") / 4).cast("int").alias("state"), "piece", "codes")
        edits = staged(pieces.union(last).mapInArrow(_edits, schema), "turn-edits")
        own = if_small(edits.filter(F.col("edited_row") != _LAST).drop("conv_id"))
        rows = self.rows.join(own, F.col("row_id") == F.col("edited_row"), "left")
        new = lambda role: F.struct(role.alias("role"), F.lit("").alias("text"))
        kept = F.when(F.coalesce("letter", F.lit("K")) != "D", F.array(F.struct(F.coalesce("new_role", "role").alias("role"), "text")))
        inserted = F.transform(F.coalesce("before", F.array().cast("array<string>")), new)
        lines = F.concat(inserted, F.coalesce(kept, F.array().cast("array<struct<role:string,text:string>>")))
        ends = edits.filter(F.col("edited_row") == _LAST).select("conv_id", F.col("edited_row").alias("row_id"), F.transform("before", new).alias("lines"))
        whole = rows.select("conv_id", "row_id", lines.alias("lines")).union(ends)
        return whole.select("conv_id", "row_id", F.posexplode("lines").alias("nth", "line")).select("conv_id", "row_id", "nth", "line.role", "line.text")

    def digests(self) -> DataFrame:
        """conv_id and the SHA-256 of the repaired rows as ``role:text``, joined by line breaks.

        The hash of a conversation takes its rows one after the other, so they pass through one task, which holds
        one row at a time.
        """
        lines = self.repaired().select("conv_id", "row_id", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
        order = ["conv_id", "row_id", "nth"]
        lines = lines.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "line")
        return lines.mapInArrow(_digests, T.StructType([T.StructField("conv_id", self._id), T.StructField("digest", T.StringType())]))


def _part(conv_id: Column, turn: Column) -> Column:
    key = F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv_id, turn)))
    return F.crc32(key) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` with one twentieth each left out, emptied, without ``.!?``, repeated, or said by the user.

    Which it is follows from conv_id and turn; a null is one space.
    """
    part = _part(F.col("conv_id"), F.col("turn"))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), part.alias("part"))
    text = F.when(F.col("part") == 1, "").when(F.col("part") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("part") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("part") == 3, 2).otherwise(1)))
    return rows.filter("part <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def repaired_conversations(conversations: DataFrame) -> DataFrame:
    """Report and digest of every conversation of the table after ``damaged``; those without rows have zeros."""
    repair = Repair(damaged(conversations))
    report, digests = repair.report(), repair.digests().withColumnRenamed("conv_id", "hashed")
    given = conversations.select(F.col("conv_id").alias("given")).distinct()
    zero = {c: F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return (
        given.join(report, F.col("given").eqNullSafe(F.col("conv_id")), "left")
        .join(digests, F.col("given").eqNullSafe(F.col("hashed")), "left")
        .select(
            F.col("given").alias("conv_id"), *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("digest", F.lit(sha256().hexdigest())).alias("repaired_sha256"),
        )
    )
