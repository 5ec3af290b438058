"""Conversation structure repair: the cheapest edits that give every conversation an order of roles that a model can learn.

A conversation is right if its role initials read `(s?(ua)+)?`. Keeping a row costs 0, giving it the role
user or assistant 2, deleting it 3, inserting an empty user or assistant turn 2; a truncated row that
stays costs 1 more. Blank rows (no text) and duplicates (role and text seen before) must go. What the
next turn may be depends on one of four states only, and a target role on the state alone, so edits are
a word over D, I, K, R. Of the cheapest words the ASCII-least is emitted.

The least costs from each state to the end are found backwards, and stored only at every sqrt(n)-th row of
a block; walking forward, each stretch between two checkpoints is computed again, and at every row the
first letter is taken that loses nothing (a tight edit). Conversations are cut into blocks of about
`block` bytes. A block's costs from state to state are a 4 x 4 matrix over (min, +), and so is the step
that it makes of its first state; products of these, taken in groups of `fan` upwards and carried down
again, give every block its costs at the end and its first state, however long a conversation is. Most
conversations are one block and need none of this. Equal rows of one turn are counted, not gathered: all
but the first are duplicates.

Only the last step, which hashes a conversation's repaired text as a whole, has a conversation's blocks
pass one task, in order and block by block (SHA-256 can't be split).

Order: turn (nulls first), then role, then the MD5 of the text. Null role or text: one space. Null conv_id:
one conversation. Repeated rows: duplicates. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import in_order, small_batches, staged

BLOCK, FAN = 1 << 18, 1024
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
SPACE = " \t\n\x0b\x0c\r"
FAR = 1 << 40
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. By state: the next state by initial (s, u, a, other; -1: never), and that after a turn of the only other role to choose.
KEEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
FORCED = (2, 2, 3, 2)
TARGET = ("user", "user", "assistant", "user")
#: Costs from each state at the end of a conversation: it may end in 0 and 3.
END = (0, 4, 2, 0)

Costs = tuple[int, int, int, int]


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, with faults chosen by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 removes its full stops, 3 repeats it, 4 makes it a user's."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("kind__"))
    k = F.col("kind__")
    rows = rows.where(k != 0).withColumns({"text": F.when(k == 1, "").when(k == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")), "role": F.when(k == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy__", F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind__", "copy__")


def _key(c: str = "conv_id") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))


def placed(conversations: DataFrame, block: int) -> DataFrame:
    """key, conv_id, turn, role, text, n (equal rows), place, block, sort of role (0 to 3), blank, cut and two hashes: distinct rows in order."""
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(_key().alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"), null("role").alias("role"), null("text").alias("text"))
    rows = rows.groupBy("key", "turn", "role", "text").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
    rest, initial = F.rtrim("text", F.lit(SPACE)), F.substring("role", 1, 1)
    rows = rows.withColumns(
        {"initial": initial, "sort": F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3), "blank": rest == "", "cut": ~F.substring(rest, -1, 1).isin(".", "!", "?"), "a": F.xxhash64("role", "text"), "b": F.xxhash64(F.lit(7), "text", "role"), "digest": F.md5("text")}
    )
    size = (F.octet_length("text") + F.octet_length("role") + 64).cast("long")
    out = in_order(rows, [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")], {"bytes": size})
    return out.select("*", F.col("place__").alias("place"), F.floor(F.col("bytes") / block).cast("long").alias("block")).drop("place__", "bytes", "digest")


def step(v: Costs, code: int) -> Costs:
    """Costs before a row from those after it; code: sort of role, 4 if the row must go, 8 if it is truncated."""
    if code & 4:
        c0, c1, c2, c3 = v[0] + DELETE, v[1] + DELETE, v[2] + DELETE, v[3] + DELETE
    else:
        more = TRUNCATED if code & 8 else 0
        sort, u, a = code & 3, v[2] + more, v[3] + more
        c0 = min(v[0] + DELETE, u + (0 if sort == 1 else REROLE), v[1] + more if sort == 0 else FAR)
        c1 = min(v[1] + DELETE, u + (0 if sort == 1 else REROLE))
        c2 = min(v[2] + DELETE, a + (0 if sort == 2 else REROLE))
        c3 = min(v[3] + DELETE, u + (0 if sort == 1 else REROLE))
    d2, d3 = min(c2, c3 + INSERT), min(c3, c2 + INSERT)
    return min(c0, d2 + INSERT), min(c1, d2 + INSERT), d2, d3


def walk(codes: list[int], v: Costs, state: int, last: bool) -> tuple[list[tuple[str, int, int]], int]:
    """Edits (letter, state before, row) from a state on, with the costs v after the last row, and the state after them."""
    n = len(codes)
    size = isqrt(n) + 1
    marks, at = {n: v}, v
    for i in range(n - 1, 0, -1):
        at = step(at, codes[i])
        if i % size == 0:
            marks[i] = at
    out = []
    for begin in range(0, n, size):
        end = min(begin + size, n)
        costs = [marks[end]]
        for i in range(end - 1, begin - 1, -1):
            costs.append(step(costs[-1], codes[i]))
        for i in range(begin, end):
            here, after, code = costs[end - i], costs[end - i - 1], codes[i]
            more = TRUNCATED if code & 8 else 0
            while True:
                if here[state] == after[state] + DELETE:
                    out.append(("D", state, i))
                    break
                if here[state] == here[FORCED[state]] + INSERT:
                    out.append(("I", state, i))
                    state = FORCED[state]
                    continue
                kept = KEEP[state][code & 3]
                if kept >= 0 and here[state] == after[kept] + more:
                    out.append(("K", state, i))
                    state = kept
                else:
                    out.append(("R", state, i))
                    state = FORCED[state]
                break
    while last and END[state]:
        out.append(("I", state, n))
        state = FORCED[state]
    return out, state


def times(a: list[int], b: list[int]) -> list[int]:
    """The (min, +) product of two 4 x 4 matrices."""
    return [min(FAR, *(a[4 * i + k] + b[4 * k + j] for k in range(4))) for i in range(4) for j in range(4)]


def matrix(codes: list[int]) -> list[int]:
    """Least costs through a block from each state before to each state after it."""
    out = []
    for j in range(4):
        v: Costs = tuple(0 if i == j else FAR for i in range(4))  # type: ignore[assignment]
        for code in reversed(codes):
            v = tuple(min(FAR, x) for x in step(v, code))  # type: ignore[assignment]
        out.append(v)
    return [out[j][i] for i in range(4) for j in range(4)]


def _groups(level: DataFrame, fan: int) -> DataFrame:
    return level.groupBy("key", F.floor(F.col("idx") / fan).cast("long").alias("parent")).agg(F.sort_array(F.collect_list(F.struct("idx", "m"))).alias("all"))


def scan(nodes: DataFrame, vector: list[int], backward: bool, fan: int = FAN) -> DataFrame:
    """key, idx, v: the product of the matrices m after (or before) each node of a key with the vector that holds at the key's end (or start)."""

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for group in batch.column(2).to_pylist():
                m = group[0]["m"]
                for x in group[1:]:
                    m = times(m, x["m"])
                out.append(m)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int64()))], ["key", "idx", "m"])

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, out = [], [], []
            for key, group, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for x in reversed(group) if backward else group:
                    keys.append(key)
                    at.append(x["idx"])
                    out.append(v)
                    m = x["m"]
                    v = [min(FAR, *(m[4 * i + k] + v[k] for k in range(4))) for i in range(4)] if backward else [min(FAR, *(v[k] + m[4 * k + i] for k in range(4))) for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(at, pa.int64()), pa.array(out, pa.list_(pa.int64()))], ["key", "idx", "v"])

    levels, most = [staged(nodes, "nodes")], 0
    most = levels[0].agg(F.max("idx")).first()[0] or 0
    while most:
        levels.append(staged(_groups(levels[-1], fan).mapInArrow(up, "key string, idx long, m array<long>"), "nodes"))
        most //= fan
    found = levels[-1].select("key", "idx", F.array(*map(F.lit, vector)).cast("array<long>").alias("v"))
    for level in reversed(levels[:-1]):
        found = _groups(level, fan).join(found.withColumnRenamed("idx", "parent"), ["key", "parent"]).select("key", "all", "v").mapInArrow(down, "key string, idx long, v array<long>")
    return staged(found, "scanned")


def _ends(light: DataFrame, marks: DataFrame, fan: int) -> DataFrame | None:
    """key, block, v (costs after the block), state (before it) and last, for the blocks of conversations of several blocks."""
    several = staged(light.groupBy("key").agg(F.min("block").alias("lo"), F.max("block").alias("hi")).where("lo < hi"), "several")
    if several.isEmpty():
        return None
    rows = light.join(several, "key").join(marks.select("key", "place", F.lit(True).alias("again")), ["key", "place"], "left")
    code = F.col("sort") + F.when(F.col("blank") | F.col("again"), 4).otherwise(0) + F.when(F.col("cut"), 8).otherwise(0)
    codes = rows.groupBy("key", (F.col("block") - F.col("lo")).alias("idx"), "block", (F.col("block") == F.col("hi")).alias("last")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", code.alias("code")))), lambda x: x["code"]).alias("codes"))
    codes = staged(codes, "codes")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(map(matrix, batch.column(2).to_pylist())), pa.list_(pa.int64()))], ["key", "idx", "m"])

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for of, v, last in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                to = [walk(of, tuple(v), s, last)[1] for s in range(4)]
                out.append([0 if to[i] == j else FAR for i in range(4) for j in range(4)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.list_(pa.int64()))], ["key", "idx", "m"])

    kind = "key string, idx long, m array<long>"
    after = scan(codes.select("key", "idx", "codes").mapInArrow(matrices, kind), list(END), True, fan)
    before = scan(codes.join(after, ["key", "idx"]).select("key", "idx", "codes", "v", "last").mapInArrow(steps, kind), [0, FAR, FAR, FAR], False, fan)
    state = (F.array_position("v", F.lit(0).cast("long")) - 1).cast("int")
    return codes.select("key", "idx", "block", "last").join(after, ["key", "idx"]).join(before.select("key", "idx", state.alias("state")), ["key", "idx"]).drop("idx")


def pieces(conversations: DataFrame, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """A row for each block of a conversation: key, block, conv_id, audit, text (the repaired block, null if nothing stays), sha256 (if the conversation is one block), counts, initials at both ends, cost."""
    rows = placed(conversations, block)
    light = staged(rows.drop("role", "text"), "light")
    again = light.groupBy("key", "a", "b").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1")
    marks = staged(light.join(again, ["key", "a", "b"]).where("place > first").select("key", "block", "place"), "again")
    ends = _ends(light, marks, fan)

    row = F.struct("place", "role", "text", "initial", "sort", "blank", "cut", "n", "conv_id")
    parts = [rows.select("key", "block", row.alias("row")), marks.select("key", "block", F.col("place").alias("again"))]
    if ends is not None:
        parts.append(ends.select("key", "block", F.struct("v", "state", "last").alias("ends")))
    whole = parts[0].unionByName(parts[1], allowMissingColumns=True)
    whole = whole.unionByName(parts[2], allowMissingColumns=True) if ends is not None else whole.withColumn("ends", F.lit(None).cast("struct<v: array<long>, state: int, last: boolean>"))
    # a long, a mark and costs go to their block; texts are shuffled once
    met = whole.groupBy("key", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"), F.collect_list("again").alias("again"), F.max("ends").alias("ends"))
    met = met.select("key", "block", F.get("rows", F.lit(0))["conv_id"].alias("conv_id"), F.transform("rows", lambda x: F.struct(*[x[c].alias(c) for c in ("place", "role", "text", "initial", "sort", "blank", "cut", "n")])).alias("rows"), "again", "ends")
    small_batches(conversations.sparkSession, 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "block", "conv_id", "audit", "text", "sha256", "blank", "duplicate", "truncated", "illegal", "cost", "first", "last"]
        for batch in batches:
            made = [_repaired(of, set(again), ends) for of, again, ends in zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)]
            texts = [pa.array([m[i] for m in made], pa.string()) for i in range(3)]
            counts = [pa.array([m[i] for m in made], pa.int64()) for i in range(3, 8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *texts, *counts, *[pa.array([m[i] for m in made], pa.string()) for i in (8, 9)]], names)

    kind = met.schema["conv_id"].dataType.simpleString()
    return met.mapInArrow(run, f"key string, block long, conv_id {kind}, audit string, text string, sha256 string, blank long, duplicate long, truncated long, illegal long, cost long, first string, last string")


def _repaired(rows: list[dict], again: set[int], ends: dict | None) -> tuple:
    """What pieces() tells of a block."""
    codes = [r["sort"] + (4 if r["blank"] or r["place"] in again else 0) + (8 if r["cut"] else 0) for r in rows]
    edits, _ = walk(codes, tuple(ends["v"]), ends["state"], ends["last"]) if ends else walk(codes, END, 0, True)
    audit, lines, cost = [], [], 0
    for letter, state, i in edits:
        audit.append(letter)
        if letter == "I":
            lines.append(f"{TARGET[state]}:")
            cost += INSERT
            continue
        r = rows[i]
        if letter == "D":
            cost += DELETE
        else:
            lines.append(f"{r['role'] if letter == 'K' else TARGET[state]}:{r['text']}")
            cost += (REROLE if letter == "R" else 0) + (TRUNCATED if r["cut"] else 0)
        audit.append("D" * (r["n"] - 1))  # equal rows are duplicates
        cost += DELETE * (r["n"] - 1)
    blank = sum(r["n"] for r in rows if r["blank"])
    duplicate = sum(r["n"] - (r["place"] not in again) for r in rows if not r["blank"])
    truncated = sum(1 for r, c in zip(rows, codes, strict=True) if c & 12 == 8)
    initials = [r["initial"] for r in rows]
    illegal = sum(r["n"] - 1 for r in rows) + sum(x + y not in LEGAL for x, y in zip(initials, initials[1:], strict=False))
    text = "\n".join(lines) if lines else None
    return "".join(audit), text if ends else None, None if ends else hashlib.sha256((text or "").encode()).hexdigest(), blank, duplicate, truncated, illegal, cost, initials[0], initials[-1]


LEGAL = ("su", "ua", "au")


def audits(conversations: DataFrame, ids: DataFrame | None = None, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 for each conversation, and for each conv_id of ids."""
    small = ["blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, key, made = ["key", *small, "audit", "sha256"], None, None

        def done(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64() if 0 < i < 6 else pa.string()) for i in range(8)], names)

        def ended(x: dict) -> tuple:
            return (key, *[x[c] for c in small], "".join(x["audit"]), x["sha256"] or x["hash"].hexdigest())

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if made is None or r["key"] != key:
                    if made is not None:
                        out.append(ended(made))
                    key, made = r["key"], dict.fromkeys(small, 0) | {"audit": [], "hash": hashlib.sha256(), "any": False, "last": None, "sha256": r["sha256"]}
                for c in small:
                    made[c] += r[c]
                if made["last"] is not None:
                    made["illegal"] += made["last"] + r["first"] not in LEGAL
                made["last"] = r["last"]
                made["audit"].append(r["audit"])
                if r["text"] is not None:
                    made["hash"].update((b"\n" if made["any"] else b"") + r["text"].encode())
                    made["any"] = True
            yield done(out)
        if made is not None:
            yield done([ended(made)])

    parts = pieces(conversations, block, fan).select("key", "block", "audit", "text", "sha256", *small, "first", "last")
    found = parts.repartition("key").sortWithinPartitions("key", "block").mapInArrow(run, "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, sha256 string")
    by_turn = conversations.groupBy(_key().alias("key"), F.col("turn").cast("long").alias("turn")).agg(F.min("conv_id").alias("conv_id"))
    gaps = by_turn.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0).cast("long")).alias("gaps"))
    out = gaps.join(found, "key")
    if ids is not None:
        wanted = ids.groupBy(_key().alias("key")).agg(F.min("conv_id").alias("conv_id"))
        out = wanted.join(out.drop("conv_id"), "key", "left")
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("conv_id", *map(none, ["gaps", *small]), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _sql() -> str:
    """The same rows of damaged conversations in DuckDB's SQL: the least (cost, audit) from each state, row by row from the end."""
    byte = "list_reduce(list_prepend(xor(c, b), range(8)), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    bytes_ = "list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    edit = lambda letter, cost, v, r=None: f"{{'c': {cost} + {v}.c, 'a': '{letter}' || {v}.a, 'r': " + (f"list_prepend({r}, {v}.r)" if r else f"{v}.r") + "}"
    more = "CAST(cut AS INT)"

    def candidates(s: int) -> str:
        out = [edit("D", DELETE, f"s{s}")]
        for i, initial in enumerate("sua"):
            if KEEP[s][i] >= 0:
                out.append(f"CASE WHEN NOT gone AND ini = '{initial}' THEN {edit('K', more, f's{KEEP[s][i]}', 'role || chr(58) || text')} END")
        out.append(f"CASE WHEN NOT gone THEN {edit('R', f'{REROLE} + {more}', f's{FORCED[s]}', repr(TARGET[s]) + ' || chr(58) || text')} END")
        return f"list_min([{', '.join(out)}]) AS c{s}"

    insert = lambda s, v: edit("I", INSERT, v, f"'{TARGET[s]}:'")
    least = lambda s, c, v: f"list_min([{c}, {insert(s, v)}])"
    start = lambda c, a, r: f"{{'c': CAST({c} AS BIGINT), 'a': '{a}', 'r': CAST({r} AS VARCHAR[])}}"
    return f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {bytes_}), lambda c, b: {byte}), 4294967295) % 20 AS d FROM conversations
), x AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM t WHERE d <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i FROM x
), f AS MATERIALIZED (
  SELECT *, left(role, 1) AS ini, NOT blank AND seen > 1 AS dup, blank OR seen > 1 AS gone, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') AS cut,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM (SELECT *, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM o)
), g AS (
  SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
         count(*) FILTER (cut AND NOT gone) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
), dp AS (
  SELECT conv_id, n + 1 AS i, {start(0, "", "[]")} AS s0, {start(4, "II", "['user:', 'assistant:']")} AS s1, {start(2, "I", "['assistant:']")} AS s2, {start(0, "", "[]")} AS s3 FROM g
  UNION ALL
  SELECT conv_id, i, {least(0, "c0", "d2")}, {least(1, "c1", "d2")}, d2, d3 FROM (
    SELECT *, {least(2, "c2", "c3")} AS d2, {least(3, "c3", "c2")} AS d3 FROM (
      SELECT f.conv_id, f.i, {", ".join(candidates(s) for s in range(4))} FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i - 1))
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(s0.c, 0) AS cost, coalesce(s0.a, '') AS audit, sha256(coalesce(array_to_string(s0.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN dp ON dp.conv_id IS NOT DISTINCT FROM k.conv_id AND dp.i = 1"""


SQL = _sql()
