"""Conversation structure repair by signatures: what each row is becomes one letter, each distinct string of letters is solved once, and the edits
that it gets go back to the rows of all conversations that share it."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import cut, giving_back, slices, tables

#: Bytes that do not count as text.
BLANK = " \t\n\x0b\x0c\r"
#: Places in a row whose letters are solved together; a conversation with more of them, or one that lies in two tasks, is put together from such blocks.
BLOCK = 1 << 14
#: Costs of edits: delete, insert, another role, and a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: What was said so far: nothing, a system row, a user row, an assistant row. NEXT is what may follow, as (said, role).
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: (USER, "U"), SYSTEM: (USER, "U"), USER: (ASSISTANT, "A"), ASSISTANT: (USER, "U")}
#: What it costs to end there: a system row alone and a user row need inserts.
END = (0, 2 * INSERT, INSERT, 0)
NEVER = 1 << 40
#: Signatures up to this length are remembered, in a table of this many.
SHORT, REMEMBERED = 64, 1 << 15
#: Edits as the rows carry them: Keep, Delete, insert a User or Assistant row, make a row user or assistant; and as an audit shows them.
EDITS, SHOWN = "KDUAua", "KDIIRR"


def _one(letter: str, goal: tuple[int, ...]) -> list[tuple[int, str, int]]:
    """For a row's letter and the costs from each state after it: the cost from each state before it, with the first edit of the cheapest
    (the ASCII-least in an audit: D, I, K, R) and the state that this edit leads to."""
    stays = TRUNCATED if letter.isupper() else 0
    kept = {"s": SYSTEM, "u": USER, "a": ASSISTANT}.get(letter.lower())
    out: list[tuple[int, str, int]] = []
    for said in range(4):
        then, role = NEXT[said]
        keeps = kept == SYSTEM and said == NOTHING or kept == then
        out.append(min((DELETE + goal[said], "D", said), *([(stays + goal[kept], "K", kept)] if keeps else []), (REROLE + stays + goal[then], "R", then)))
    for _ in range(3):
        for said in range(4):
            then, role = NEXT[said]
            out[said] = min(out[said], (INSERT + out[then][0], "I", then))
    return out


def _product(a: tuple, b: tuple) -> tuple:
    return tuple(tuple(min(a[p][m] + b[m][q] for m in range(4)) for q in range(4)) for p in range(4))


def costs(signature: str) -> tuple:
    """The least cost from each state before a signature to each state after it. Solved by halves, which are remembered if short."""
    return (_costs if len(signature) <= SHORT else _costs.__wrapped__)(signature)


@lru_cache(REMEMBERED)
def _costs(signature: str) -> tuple:
    if len(signature) > 1:
        half = len(signature) // 2
        return _product(costs(signature[:half]), costs(signature[half:]))
    if not signature:
        return tuple(tuple(0 if p == q else NEVER for q in range(4)) for p in range(4))
    to = [_one(signature, tuple(0 if q == r else NEVER for r in range(4))) for q in range(4)]
    return tuple(tuple(min(to[q][p][0], NEVER) for q in range(4)) for p in range(4))


def before(matrix: tuple, goal: tuple[int, ...]) -> tuple[int, ...]:
    """The costs from each state before a signature, less the smallest: only their differences decide."""
    each = [min(row[q] + goal[q] for q in range(4)) for row in matrix]
    return tuple(c - min(each) for c in each)


def solve(signature: str, said: int, goal: tuple[int, ...]) -> tuple[tuple[str, ...], int, int]:
    """The cheapest edits of each letter, ASCII-least as an audit, the state after them and their cost. Solved by halves, as costs are."""
    return (_solve if len(signature) <= SHORT else _solve.__wrapped__)(signature, said, goal)


@lru_cache(REMEMBERED)
def _solve(signature: str, said: int, goal: tuple[int, ...]) -> tuple[tuple[str, ...], int, int]:
    if not signature:
        return (), said, 0
    if len(signature) > 1:
        half = len(signature) // 2
        first, middle, a = solve(signature[:half], said, before(costs(signature[half:]), goal))
        rest, last, b = solve(signature[half:], middle, goal)
        return first + rest, last, a + b
    ways, edits, cost = _one(signature, goal), "", 0
    while True:
        total, edit, then = ways[said]
        role = NEXT[said][1]
        edits += {"I": role, "R": role.lower()}.get(edit, edit)
        cost += total - (ways[then][0] if edit == "I" else goal[then])
        said = then
        if edit != "I":
            return (edits,), said, cost


def ending(said: int) -> str:
    """The inserts that end a conversation."""
    return {SYSTEM: "UA", USER: "A"}.get(said, "")


class Repaired(NamedTuple):
    """conversations: conv, blank, duplicate, truncated, illegal, gaps, cost, a row each. rows: conv, turn, role, key, place, edits."""

    conversations: DataFrame
    rows: DataFrame


def _texts(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    one = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), one(role_col).alias("role"), one(text_col).alias("text"))
    return rows.withColumn("key", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _row(turn: Column | None = None) -> Column:
    """What tells rows apart, as one value: nulls within it are equal."""
    return F.struct("conv", (F.col("turn") if turn is None else turn).alias("turn"), "role", "key").alias("row")


def _lawful(pair: Column) -> Column:
    return pair.isin("su", "ua", "au")


def _items(placed: DataFrame) -> DataFrame:
    """A row a conversation and block: the signature, the places of its letters, and what the block adds to the conversation's figures."""
    struct = F.struct("place", "turn", "initial", "letter", "n", "blank", "first", "open")
    blocks = placed.groupBy("conv", F.expr(f"place div {BLOCK}").alias("block")).agg(F.sort_array(F.collect_list(struct)).alias("x"))
    x = F.col("x")
    letters = F.filter(x, lambda i: i["letter"].isNotNull())
    total = lambda value: F.aggregate(x, F.lit(0).cast("long"), lambda a, i: a + value(i))
    when = lambda c, v: F.when(c, v).otherwise(F.lit(0)).cast("long")
    inner = F.zip_with(F.slice(x, F.lit(1), F.size(x) - 1), F.slice(x, F.lit(2), F.size(x)), lambda a, b: when(~_lawful(F.concat(a["initial"], b["initial"])), 1))
    turns = F.filter(F.transform(x, lambda i: i["turn"]), lambda t: t.isNotNull())
    return blocks.select(
        "conv",
        "block",
        F.element_at(x, 1)["place"].alias("at"),
        F.element_at(x, -1)["place"].alias("end"),
        F.array_join(F.transform(letters, lambda i: i["letter"]), "").alias("signature"),
        F.transform(letters, lambda i: i["place"]).alias("places"),
        total(lambda i: when(i["blank"], i["n"])).alias("blank"),
        total(lambda i: when(~i["blank"], i["n"] - when(i["first"], 1))).alias("duplicate"),
        total(lambda i: when(i["letter"].isNotNull() & i["open"], 1)).alias("truncated"),
        (total(lambda i: i["n"] - 1) + F.aggregate(inner, F.lit(0).cast("long"), lambda a, b: a + b)).alias("illegal"),
        F.array_min(turns).alias("least"),
        F.array_max(turns).alias("most"),
        F.size(F.array_distinct(turns)).cast("long").alias("turns"),
        F.element_at(x, 1)["turn"].alias("first_turn"),
        F.element_at(x, -1)["turn"].alias("last_turn"),
        F.element_at(x, 1)["initial"].alias("first_initial"),
        F.element_at(x, -1)["initial"].alias("last_initial"),
    )


def _solved(rows: DataFrame) -> DataFrame:
    """edits of each letter, ends, the cost and the state after, of each distinct (signature, said, goal)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = [solve(r["signature"], r["said"], tuple(r["goal"])) for r in batch.to_pylist()]
            out = [pa.array([list(g[0]) for g in got], pa.list_(pa.string())), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *out], [*batch.schema.names, "edits", "after", "cost"])

    return rows.select("signature", "said", "goal").distinct().mapInArrow(giving_back(run), "signature string, said int, goal array<int>, edits array<string>, after int, cost long")


def _several(multi: DataFrame) -> DataFrame:
    """at, said, goal of the blocks of conversations that lie in several. Costs are put together from the last block back, then states from
    the first one on; a block is 16 numbers, then four, in these two passes over a conversation's blocks."""

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            flat = [[c for row in costs(s) for c in row] for s in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat, pa.list_(pa.int64()))], ["signature", "matrix"])

    def backward(group: pa.Table) -> pa.Table:
        group = group.sort_by([("block", "descending")])
        goal, goals = END, []
        for flat in group["matrix"].to_pylist():
            goals.append(goal)
            goal = before([flat[i : i + 4] for i in range(0, 16, 4)], goal)
        return pa.table({"conv": group["conv"], "block": group["block"], "at": group["at"], "signature": group["signature"], "goal": pa.array(map(list, goals), pa.list_(pa.int32()))})

    def forward(group: pa.Table) -> pa.Table:
        group = group.sort_by([("block", "ascending")])
        said, starts = NOTHING, []
        for after in group["after"].to_pylist():
            starts.append(said)
            said = after[said]
        return pa.table({"at": group["at"], "said": pa.array(starts, pa.int32()), "goal": group["goal"]})

    kind = multi.schema["conv"].dataType.simpleString()
    known = multi.select("signature").distinct().mapInArrow(matrices, "signature string, matrix array<long>")
    goals = multi.select("conv", "block", "at", "signature").join(known, "signature").groupBy("conv").applyInArrow(backward, f"conv {kind}, block long, at long, signature string, goal array<int>")
    each = goals.select("signature", "goal").distinct().select("signature", F.explode(F.array(*map(F.lit, range(4)))).alias("said"), "goal")
    after = _solved(each).groupBy("signature", "goal").agg(F.array_sort(F.collect_list(F.struct("said", "after"))).alias("x")).select("signature", "goal", F.transform("x", lambda s: s["after"]).alias("after"))
    return goals.join(after, ["signature", "goal"]).select("conv", "block", "at", "goal", "after").groupBy("conv").applyInArrow(forward, "at long, said int, goal array<int>")


def repair(df: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repaired:
    """The cheapest edits that give each conversation roles of the form (s?(ua)+)?, by initials, without blank, repeated or unmarked truncated rows.

    A row's first fault counts: blank (nothing but BLANK), duplicate (role and text said before in the conversation), truncated (the last sign that is
    not BLANK is none of . ! ?). Keep costs nothing, Rerole to user or assistant REROLE, Delete DELETE, Insert an empty user or assistant row INSERT; a
    truncated row that stays adds TRUNCATED. Blank rows and duplicates must go. Among the cheapest, the ASCII-least string of initials is taken.

    Rows come in order of turn (null first), then role, then the SHA-256 of the text (`key`), which stands for the text until edits are replayed; rows that
    repeat all of these lie side by side. Null roles and texts count as one space; null conversations are one conversation. A table without rows gives none;
    other columns of df are not read. turn is a whole number (others fail when Spark casts them).

    Rows that are equal are counted first, by partial sums. What is left is ranged by (conv, turn, role, key), so a conversation of any size is split, and
    blocks of BLOCK places become signatures, in which blank rows and duplicates have no letter, since their edit is known. Each distinct signature is solved
    once; a conversation of several blocks is put together from the costs between the states at their borders. Texts are moved by `replay` alone.
    """
    spark = df.sparkSession
    text = _texts(df, conv_col, turn_col, role_col, text_col)
    bare = F.rtrim("text", F.lit(BLANK))
    rows = text.select("conv", "turn", "role", "key", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("open"))
    with tables(spark) as own:
        counted = own.keep(rows.groupBy("conv", "turn", "role", "key", "blank", "open").agg(F.count("*").alias("n")), "counted")
        said = counted.filter(~F.col("blank")).groupBy("conv", "role", "key").agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("at"))
        said = said.select(_row(turn=F.col("at.turn")), F.lit(True).alias("first"))
        both = counted.withColumn("row", _row()).join(said, "row", "left")
        initial = F.substring("role", 1, 1)
        letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
        first = F.coalesce("first", F.lit(False))
        letter = F.when(first & ~F.col("blank"), F.when(F.col("open"), F.upper(letter)).otherwise(letter))
        marked = both.select("conv", "turn", "role", "key", "n", "blank", "open", first.alias("first"), initial.alias("initial"), letter.alias("letter"))
        order = ["conv", "turn", "role", "key"]
        placed = own.keep(marked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
        blocks = own.keep(_items(placed), "blocks")

        line = Window.partitionBy("conv").orderBy("block")
        last = F.lead("at").over(line).isNull()
        chain = own.keep(blocks.drop("places").withColumns({"several": F.lead("at").over(line).isNotNull() | F.lag("at").over(line).isNotNull(), "last": last, "joint": F.lag("last_initial").over(line), "turn_before": F.lag("last_turn").over(line)}), "chain")
        starts = _several(chain.filter("several")).unionByName(chain.filter("NOT several").select("at", F.lit(NOTHING).alias("said"), F.array(*map(F.lit, END)).alias("goal")))
        asked = own.keep(chain.select("at", "signature").join(starts, "at"), "asked")
        solved = own.keep(asked.join(_solved(asked), ["signature", "said", "goal"]).select("at", "edits", "after", "cost"), "solved")
        whole = chain.join(solved, "at").withColumn("ends", F.when(F.col("last") & (F.col("after") == SYSTEM), "UA").when(F.col("last") & (F.col("after") == USER), "A").otherwise(""))
        border = F.when(~_lawful(F.concat("joint", "first_initial")), 1).otherwise(0)
        shared = F.when(F.col("turn_before") == F.col("first_turn"), 1).otherwise(0)
        total = whole.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + border).alias("illegal"), F.coalesce(F.max("most") - F.min("least") + 1 - F.sum(F.col("turns") - shared), F.lit(0)).cast("long").alias("gaps"), F.sum(F.col("cost") + DELETE * (F.col("blank") + F.col("duplicate")) + INSERT * F.length("ends")).alias("cost"))

        zipped = blocks.select("at", "places").join(solved.select("at", "edits"), "at").select(F.explode(F.arrays_zip("places", "edits")).alias("z")).select(F.col("z.places").alias("place"), F.col("z.edits").alias("own"))
        edited = placed.join(zipped.filter("own <> 'K'"), "place", "left")
        lettered = F.col("letter").isNotNull()
        edits = F.concat(F.when(lettered, F.coalesce("own", F.lit("K"))).otherwise(""), F.expr("repeat('D', cast(n - if(letter IS NULL, 0, 1) AS int))"))
        rows = edited.select("conv", "turn", "role", "key", (F.col("place") * 2).alias("place"), edits.alias("edits"))
        ends = whole.filter("ends <> ''").select("conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("key"), (F.col("end") * 2 + 1).alias("place"), F.col("ends").alias("edits"))
        return Repaired(cut(total), cut(rows.unionByName(ends)))


def replay(df: DataFrame, repaired: Repaired, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, place, edits, role, text of the rows of df and of those inserted at the end of conversations, in which (conv, place) is the order; role and text
    are those of the row before its edits, without text if it goes. df is the table that was repaired. A row's edits may insert rows before it."""
    wanted = repaired.rows.withColumn("stays", F.col("edits").rlike("[Kua]"))
    texts = _texts(df, conv_col, turn_col, role_col, text_col).select(_row(), "text").groupBy("row").agg(F.first("text").alias("text"))
    there = wanted.filter("stays").withColumn("row", _row()).join(texts, "row").select("conv", "place", "edits", "role", "text")
    return there.unionByName(wanted.filter("NOT stays").select("conv", "place", "edits", "role", F.lit(None).cast("string").alias("text")))


def repaired_rows(replayed: DataFrame) -> DataFrame:
    """conv, place, part, role, text: the repaired conversations, in order of (conv, place, part)."""
    each = replayed.select("conv", "place", F.posexplode(F.split("edits", "")).alias("part", "edit"), "role", "text").filter("edit <> 'D' AND edit <> ''")
    role = F.when(F.col("edit") == "K", F.col("role")).when(F.lower("edit") == "u", "user").otherwise("assistant")
    return each.select("conv", "place", "part", role.alias("role"), F.when(F.col("edit").isin("U", "A"), "").otherwise(F.col("text")).alias("text"))


def digests(replayed: DataFrame) -> DataFrame:
    """conv, audit, sha256 of each conversation: the initials of its edits, and the hash of its repaired rows as role:text, a line each.

    A hash reads a conversation in order, so a conversation is one task's work here, row by row; a task holds its audit, but none of its texts."""
    kind = replayed.schema["conv"].dataType
    shown = str.maketrans(EDITS, SHOWN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, any_yet, began = None, [], hashlib.sha256(), False, False
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (to_arrow_type(kind), pa.string(), pa.string()), strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["conv", "audit", "sha256"])

        for batch in slices(batches):
            for c, edits, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv", "edits", "role", "text")), strict=True):
                if began and c != conv:
                    out.append((conv, "".join(audit), sha.hexdigest()))
                    audit, sha, any_yet = [], hashlib.sha256(), False
                conv, began = c, True
                audit.append(edits.translate(shown))
                for e in edits.replace("D", ""):
                    line = f"{role}:{text}" if e == "K" else f"{'user' if e in 'Uu' else 'assistant'}:{text if e in 'ua' else ''}"
                    sha.update((("\n" if any_yet else "") + line).encode())
                    any_yet = True
            if len(out) >= 1024:
                yield batch_of()
        if began:
            out.append((conv, "".join(audit), sha.hexdigest()))
        if out:
            yield batch_of()

    ordered = replayed.repartition("conv").sortWithinPartitions("conv", "place")
    return ordered.mapInArrow(giving_back(run), f"conv {kind.simpleString()}, audit string, sha256 string")
