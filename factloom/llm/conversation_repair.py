"""Repair of conversation structure by a dynamic program with square-root checkpoints.

Rows of a conversation are kept, given another role, deleted or joined by inserted turns, so that the roles form an optional
system turn and then pairs of user and assistant, at least cost; of the cheapest edits the ASCII-least audit counts. The
automaton of roles has four states, so what a run of rows can cost is a 4 x 4 table in min-plus arithmetic.

Conversations are sorted over all tasks and cut into blocks of about the square root of all rows, so no conversation holds more
than about that many blocks either. Backward vectors of costs (least cost from each state to the end) are kept at the ends of
blocks alone, chained from the blocks' tables; then each block recomputes the vectors inside it and walks forward from each
state that it may be entered in, and a chain over blocks picks the state that it is entered in. All work on rows is dealt by
blocks, whatever the size of a conversation; only block summaries and, since SHA-256 has to read it in order, the repaired
text pass one task per conversation, as a stream.

Damage and edge cases: the query damages the rows first (``damaged``). A null role, text, turn or conv_id reads as one space
where a string is asked for; null turns come first and do not count for gaps; rows of one turn are taken by role, then text;
equal rows are duplicates of each other; repeated rows of the table are rows. A role other than user, assistant and system
can't be kept unless its initial is theirs; an empty role has no initial. A null conv_id is a conversation of its own. A
conversation without rows after damage has zeros, an empty audit and the hash of the empty string; an empty table gives no
rows. Texts may be of any length; a block's texts are held one Arrow batch at a time. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, keyed_join, text_batches

#: Costs of the edits, and what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: White space of blank rows and behind a row's last letter.
SPACES = " \t\n\v\f\r"
#: A row in one byte: the place of its initial in INITIALS (NO_INITIAL: none, OTHER: no role's), MUST_GO, CUT_OFF.
INITIALS = "sua"
NO_INITIAL, OTHER, MUST_GO, CUT_OFF = 3, 4, 8, 16
#: States: nothing yet, after system, after user, after assistant; what an initial leads to, and the role that may come next.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER} | {(s, NO_INITIAL): s for s in range(4)}
AFTER = (USER, USER, ASSISTANT, USER)
ROLE_OF = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}
ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
#: Bytes of a batch that leaves a worker.
BATCH_BYTES = 1 << 22
#: More than any conversation costs.
NEVER = 1 << 60

Costs = tuple[int, int, int, int]


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, text) after the damage that crc32 of ``conv_id:turn`` deals to each row."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(blank("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return rows.where("fault <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def closed(costs: Costs) -> Costs:
    """Least costs when turns may be inserted first."""
    start, system, user, assistant = costs
    user, assistant = min(user, assistant + INSERT), min(assistant, user + INSERT)
    return min(start, user + INSERT), min(system, user + INSERT), user, assistant


def edits(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, state after it) of what may be done with a row."""
    yield "D", DELETE, state
    if not code & MUST_GO:
        more = TRUNCATED if code & CUT_OFF else 0
        kept = NEXT.get((state, code & 7))
        if kept is not None:
            yield "K", more, kept
        yield "R", REROLE + more, AFTER[state]


MOVES = {code: tuple(tuple(edits(code, s)) for s in range(4)) for code in (i + f for i in range(5) for f in (0, MUST_GO, CUT_OFF))}
#: Costs at the end of a conversation: it may end empty or behind an assistant.
END = closed((0, NEVER, NEVER, 0))


def before(code: int, costs: Costs) -> Costs:
    """Least costs to the end before a row, given those behind it."""
    return closed(tuple(min(cost + costs[to] for _, cost, to in moves) for moves in MOVES[code]))


def table_of(codes: bytes) -> list[int]:
    """Least costs over a block from each state it is entered in to each that it is left in, by rows."""
    columns = []
    for to in range(4):
        costs = tuple(0 if s == to else NEVER for s in range(4))
        for code in reversed(codes):
            costs = before(code, costs)
        columns.append(costs)
    return [columns[t][s] for s in range(4) for t in range(4)]


def through(table: list[int], costs: Costs) -> Costs:
    """Least costs to the end before a block, given its table and those behind it."""
    return tuple(min(NEVER, min(table[4 * s + t] + costs[t] for t in range(4))) for s in range(4))


def walk(codes: bytes, behind: Costs) -> list[tuple[str, int, int]]:
    """(audit, cost, state left in) of a block for each state that it may be entered in; ``behind``: costs at its end."""
    vectors = [behind]
    for code in reversed(codes):
        vectors.append(before(code, vectors[-1]))
    vectors.reverse()
    out = []
    for state in range(4):
        letters, spent, at = [], 0, 0
        while at < len(codes):
            left = vectors[at][state]
            options = [(letter, cost, to, at + 1) for letter, cost, to in MOVES[codes[at]][state]]
            letter, cost, state, at = min(o for o in [*options, ("I", INSERT, AFTER[state], at)] if o[1] + vectors[o[3]][o[2]] == left)
            letters.append(letter)
            spent += cost
        out.append(("".join(letters), spent, state))
    return out


def lines(rows: list[dict], audit: str, state: int) -> list[str]:
    """``role:text`` of the turns that an audit leaves, entered in ``state``."""
    out, at = [], iter(rows)
    for letter in audit:
        row = {"role": "", "text": ""} if letter == "I" else next(at)
        if letter == "K":
            initial = INITIALS.find(row["role"][:1]) if row["role"] else NO_INITIAL
            state = NEXT[state, initial]
            out.append(f"{row['role']}:{row['text']}")
        elif letter != "D":
            state = AFTER[state]
            out.append(f"{ROLE_OF[state]}:{row['text']}")
    return out


def _each(run):
    """A function on rows, which takes dicts and yields tuples of the result's columns, as a step on a DataFrame."""

    def step(df: DataFrame, schema: str) -> DataFrame:
        names, types = zip(*(c.split(" ") for c in schema.split(", ")), strict=True)
        types = [ARROW[t] for t in types]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        def go(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for row in run(r for b in source for r in b.to_pylist()):
                held.append(row)
                size += sum(len(x) for x in row if isinstance(x, (str, bytes))) + 100
                if size > BATCH_BYTES:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

        return df.mapInArrow(go, schema)

    return step


@_each
def _tables(rows):
    for r in rows:
        yield r["conv"], r["start"], table_of(bytes(r["codes"]))


@_each
def _behind(rows):
    """Costs at the end of each block, read from a conversation's last block to its first."""
    for _, blocks in groupby(rows, lambda r: r["conv"]):
        costs = END
        for r in blocks:
            yield r["conv"], r["start"], list(costs)
            costs = through(r["costs"], costs)


@_each
def _walked(rows):
    for r in rows:
        codes = bytes(r["codes"])
        audits, costs, exits = map(list, zip(*walk(codes, tuple(r["behind"])), strict=True))
        initials = [c & 7 for c in codes]
        illegal = sum(p not in LEGAL for p in zip(initials, initials[1:], strict=False))
        yield r["conv"], r["start"], audits, costs, exits, illegal, initials[0], initials[-1]


@_each
def _entered(rows):
    """Of each block the state that it is entered in and its audit; the last one also has what is inserted at the end."""
    for _, blocks in groupby(rows, lambda r: r["conv"]):
        state, last, held = START, None, None
        for r in blocks:
            if held:
                yield tuple(held)
            illegal = r["illegal"] + (last is not None and (last, r["first"]) not in LEGAL)
            held = [r["conv"], r["start"], state, r["audits"][state], r["costs"][state], illegal]
            state, last = r["exits"][state], r["last"]
        while state not in (START, ASSISTANT):
            held[3] += "I"
            held[4] += INSERT
            state = AFTER[state]
        yield tuple(held)


@_each
def _repaired(rows):
    for r in rows:
        found = lines(r["turns"], r["audit"], r["state"])
        yield r["conv"], r["start"], r["audit"], r["cost"], r["illegal"], len(found), "\n".join(found).encode("utf-8", "replace")


@_each
def _joined(rows):
    """One row per conversation; its repaired text is hashed as its blocks stream by."""
    for conv, blocks in groupby(rows, lambda r: r["conv"]):
        audit, cost, illegal, any_lines, digest = [], 0, 0, False, hashlib.sha256()
        for r in blocks:
            audit.append(r["audit"])
            cost, illegal = cost + r["cost"], illegal + r["illegal"]
            if r["n_lines"]:
                digest.update(b"\n" * any_lines + r["lines"])
                any_lines = True
        yield conv, illegal, cost, "".join(audit), digest.hexdigest()


def _by_conversation(df: DataFrame, order: Column) -> DataFrame:
    """The rows of a conversation in one task, in order."""
    return df.repartition("conv").sortWithinPartitions("conv", order)


def repaired(conversations: DataFrame) -> DataFrame:
    """Per conv_id of ``conversations`` (conv_id, turn, role, text): gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of its rows after damage."""
    text_batches(conversations.sparkSession)
    key = F.sha2(F.concat_ws(":", F.length("conv"), "conv", F.length("role"), "role", "text").cast("binary"), 256)
    spaces = F.lit(SPACES)
    stripped = F.rtrim(F.col("text"), spaces)
    place = F.expr(f"instr('{INITIALS}', left(role, 1))")
    initial = F.when(F.col("role") == "", NO_INITIAL).when(place == 0, OTHER).otherwise(place - 1)
    told = damaged(conversations).withColumns({"key": F.unhex(key), "initial": initial, "blank": stripped == "", "cut": ~F.substring(stripped, -1, 1).isin(".", "!", "?")})
    told = told.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("tie")]
    rows = checkpoint(told.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("pos", F.monotonically_increasing_id()))
    width = F.lit(max(1, int(rows.count() ** 0.5)))
    # a block: neighbours in one task's part of the order, cut at multiples of the width
    block = [F.col("conv"), F.shiftright("pos", 33).alias("part"), F.floor(F.col("pos").bitwiseAND(F.lit((1 << 33) - 1)) / width).alias("block")]

    seen = checkpoint(rows.groupBy("key").agg(F.min("pos").alias("earliest"), F.count("*").alias("n")).where("n > 1"))
    marked = keyed_join(rows.drop("text", "role"), seen, "key", "n", how="left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("earliest"), F.lit(False))
    cut = ~F.col("blank") & ~duplicate & F.col("cut")
    code = F.col("initial") + F.when(F.col("blank") | duplicate, MUST_GO).when(cut, CUT_OFF).otherwise(0)
    marked = marked.select(*block, "pos", "turn", "blank", duplicate.alias("duplicate"), cut.alias("cut"), code.cast("int").alias("code"))
    blocks = marked.groupBy("conv", "part", "block").agg(F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", "code"))).alias("codes"))
    blocks = checkpoint(blocks.select("conv", "start", F.col("codes.code").alias("codes")))
    ones = lambda c: F.sum(F.col(c).cast("long")).alias(c)
    counts = marked.groupBy("conv", "turn").agg(ones("blank"), ones("duplicate"), ones("cut")).groupBy("conv")
    span = (F.max("turn").cast("decimal(38,0)") - F.min("turn") + 1 - F.count("turn")).try_cast("long")
    counts = counts.agg(F.coalesce(span, F.lit(0)).alias("gaps"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "cut")))

    tables = _tables(blocks, "conv string, start long, costs array<long>")
    behind = _behind(_by_conversation(tables, F.col("start").desc()), "conv string, start long, behind array<long>")
    walked = _walked(blocks.join(behind, ["conv", "start"]), "conv string, start long, audits array<string>, costs array<long>, exits array<long>, illegal long, first long, last long")
    entered = checkpoint(_entered(_by_conversation(walked, F.col("start")), "conv string, start long, state long, audit string, cost long, illegal long"))
    turns = rows.groupBy(*block).agg(F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns")).select("conv", "start", "turns")
    lined = _repaired(turns.join(entered, ["conv", "start"]), "conv string, start long, audit string, cost long, illegal long, n_lines long, lines binary")
    found = _joined(_by_conversation(lined, F.col("start")), "conv string, illegal long, cost long, audit string, repaired_sha256 string")

    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")))
    out = every.join(found, "conv", "left").join(counts, "conv", "left")
    zero = lambda c, name=None: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(name or c)
    return out.select(
        "conv_id", zero("gaps"), zero("blank"), zero("duplicate"), zero("cut", "truncated"), zero("illegal"), zero("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )


def repair_sql() -> str:
    """The same in SQL: a recursion over rows from the end with (cost, audit, repaired text) of each state."""
    keep = {START: (("s", "v1"), ("u", "v2")), SYSTEM: (("u", "v2"),), USER: (("a", "v3"),), ASSISTANT: (("u", "v2"),)}
    made = {START: ("user", "v2"), SYSTEM: ("user", "v2"), USER: ("assistant", "v3"), ASSISTANT: ("user", "v2")}
    put = lambda v, cost, letter, line="''": f"{{'c': {v}.c + {cost}, 'a': '{letter}' || {v}.a, 't': {line} || {v}.t}}"

    def base(s: int) -> str:
        options = [put(f"v{s}", DELETE, "D")]
        more = f"CASE WHEN cut THEN {TRUNCATED} ELSE 0 END"
        keeps = [*keep[s], ("", f"v{s}")]
        options += [f"CASE WHEN NOT blank AND NOT dup AND i = '{i}' THEN {put(v, more, 'K', "chr(10) || role || ':' || text")} END" for i, v in keeps]
        options.append(f"CASE WHEN NOT blank AND NOT dup THEN {put(made[s][1], f'{REROLE} + {more}', 'R', f"chr(10) || '{made[s][0]}:' || text")} END")
        return f"list_min([{', '.join(options)}])"

    insert = lambda v, role: put(v, INSERT, "I", f"chr(10) || '{role}:'")
    user = f"list_min([b2, {insert('b3', 'assistant')}])"
    closing = f"list_min([b0, {insert('w2', 'user')}]) AS v0, list_min([b1, {insert('w2', 'user')}]) AS v1, w2 AS v2, list_min([b3, {insert('b2', 'user')}]) AS v3"
    empty, never = "{'c': 0::BIGINT, 'a': '', 't': ''}", f"{{'c': {NEVER}::BIGINT, 'a': '', 't': ''}}"
    return f"""
WITH RECURSIVE told AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), dealt AS (
  SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len(k) + 1), lambda i: list_concat([ascii(k[i])::BIGINT], list_transform(range(8), lambda j: -1::BIGINT))))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) % 20 AS fault FROM told
), damaged AS (
  SELECT conv, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE fault <> 0
), numbered AS (
  SELECT conv, turn, role, text, role[1:1] AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS stripped,
    row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text, copy) AS pos, count(*) OVER (PARTITION BY conv) AS n FROM damaged
), faults AS (
  SELECT *, stripped = '' AS blank, stripped <> '' AND row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 AS dup, stripped <> '' AND right(stripped, 1) NOT IN ('.', '!', '?') AS tail,
    lag(i) OVER (PARTITION BY conv ORDER BY pos) AS last FROM numbered
), rows AS MATERIALIZED (SELECT *, tail AND NOT dup AS cut FROM faults),
ends AS (SELECT conv, n, {empty} AS b0, {never} AS b1, {never} AS b2, {empty} AS b3 FROM rows WHERE pos = 1),
first AS (SELECT *, {user} AS w2 FROM ends),
steps AS (
  SELECT conv, n + 1 AS pos, {closing} FROM first
  UNION ALL
  SELECT conv, pos, {closing} FROM (SELECT *, {user} AS w2 FROM (
    SELECT r.conv, r.pos, {base(0)} AS b0, {base(1)} AS b1, {base(2)} AS b2, {base(3)} AS b3 FROM rows r JOIN steps s ON r.conv = s.conv AND r.pos = s.pos - 1))
), best AS (SELECT conv, v0 FROM steps WHERE pos = 1),
counts AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (last IS NOT NULL AND last || ',' || i NOT IN ('s,u', 'u,a', 'a,u')) AS illegal FROM rows GROUP BY conv
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0.c, 0)::BIGINT AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(substr(v0.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv = coalesce(o.conv_id::VARCHAR, ' ') LEFT JOIN best b ON b.conv = coalesce(o.conv_id::VARCHAR, ' ')
"""
