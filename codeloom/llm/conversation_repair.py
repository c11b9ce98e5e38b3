"""Repair of damaged conversations: the cheapest edits that make the roles (system)? (user assistant)+, or nothing.

The search is A* on the edit lattice of rows and grammar states. Its heuristic is a suffix sum: every blank or repeated row
must be deleted, and a truncated one is charged or deleted, which costs DELETE at least. Paths are keyed by
(cost plus heuristic, audit), so that the first path to a place is the cheapest, and of those the ASCII-least.

A conversation may hold any share of all rows, so it is searched in blocks of rows, each on its own and from each state to
each state. Two audits of one cost to one place never begin with one another, as both took the same rows, so the order
of audits by their beginnings is kept when blocks are put together: a block is a small matrix of costs and orders, and
matrices multiply in groups, as a tree. What is chosen goes back down the tree to the blocks. Texts stay in Spark's
columns; they stream by once, in order, to be hashed.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import map_rows, materialise

DELETE, REROLE, INSERT, CHARGE = 2, 1, 5, 5
#: Grammar states: at the start, after the system's row, after a user's, after an assistant's; what may follow, and the last states.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The role that an edit may make in each state, and the number of inserted rows that end a conversation there.
MADE, MISSING = ("u", "u", "a", "u"), (0, 2, 1, 0)
ROLE = {"u": "user", "a": "assistant"}
#: Characters of a row as the search sees it: rows that must go, and initials of the others, as capitals where truncated ("o" for any other role).
GONE = "-"
#: The logarithm of the rows of a block, and of the blocks of a group.
BLOCK, GROUP = 9, 9
SPACE = "\\x20\\x09-\\x0D"


def search(rows: str, entry: int, last: bool, whole: bool = True) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) from state entry over rows to each state; with last, to any end of a conversation, as state START.

    Without whole, rows that are inserted after the last one are left to the next block.

    >>> search("uUa", 0, True)
    {0: (2, 'KDK')}
    """
    n = len(rows)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):  # suffix sums of what no path avoids
        least[i] = least[i + 1] + (DELETE if rows[i] == GONE or rows[i].isupper() else 0)
    heap, seen, found = [(least[0], "", 0, 0, entry)], set(), {}
    while heap:
        _, audit, cost, i, q = heapq.heappop(heap)
        if (i, q) in seen:
            continue
        seen.add((i, q))
        if i == n:
            if not last:
                found[q] = (cost, audit)
                continue
            if MISSING[q] == 0:
                return {START: (cost, audit)}
        moves = []
        if i < n:
            x = rows[i]
            moves.append((DELETE, "D", i + 1, q))
            if x != GONE:
                charge = CHARGE if x.isupper() else 0
                to = NEXT[q].get(x.lower())
                if to is not None:
                    moves.append((charge, "K", i + 1, to))
                moves.append((REROLE + charge, "R", i + 1, NEXT[q][MADE[q]]))
        if i < n or last:
            moves.append((INSERT, "I", i, NEXT[q][MADE[q]]))
        for price, edit, j, to in moves:
            if (j, to) not in seen:
                heapq.heappush(heap, (cost + price + least[j], audit + edit, cost + price, j, to))
    return found


NEVER = 1 << 60


def matrix(rows: str) -> tuple[list[int], list[int], list[str]]:
    """Costs, orders and audits from each state (four at a time) to each state; the order is that of a state's own audits."""
    costs, orders, audits = [], [], []
    for entry in range(4):
        found = search(rows, entry, False)
        own = sorted((found[q][1], q) for q in found)
        place = {q: k for k, (_, q) in enumerate(own)}
        costs += [found[q][0] if q in found else NEVER for q in range(4)]
        orders += [place.get(q, 9) for q in range(4)]
        audits += [found[q][1] if q in found else "" for q in range(4)]
    return costs, orders, audits


def product(a: tuple, b: tuple) -> tuple[list[int], list[int], list[int]]:
    """Costs and orders of two matrices in a row, and the state between them."""
    costs, orders, between = [NEVER] * 16, [9] * 16, [0] * 16
    for e in range(4):
        to = []
        for q in range(4):
            cost, o1, o2, m = min((a[0][4 * e + m] + b[0][4 * m + q], a[1][4 * e + m], b[1][4 * m + q], m) for m in range(4))
            if cost < NEVER:
                to.append(((o1, o2), q))
                costs[4 * e + q], between[4 * e + q] = cost, m
        for k, (_, q) in enumerate(sorted(to)):
            orders[4 * e + q] = k
    return costs, orders, between


def chain(parts: list[tuple]) -> tuple[list[int], list[int], list[list[int]]]:
    """The product of matrices in a row, and the states between its factors."""
    now, between = parts[0], []
    for p in parts[1:]:
        costs, orders, m = product(now, p)
        now = costs, orders
        between.append(m)
    return now[0], now[1], between


def ways(entry: int, exit_: int, between: list[list[int]]) -> list[tuple[int, int]]:
    """The states before and after each factor of a chain on the best way from entry to exit_."""
    out, q = [], exit_
    for m in reversed(between):
        p = m[4 * entry + q]
        out.append((p, q))
        q = p
    return [(entry, q), *reversed(out)]


def best_end(costs: list[int], orders: list[int]) -> int:
    """The state in which a whole conversation ends best, before the rows that are inserted after it."""
    return min(range(4), key=lambda q: (costs[q] + INSERT * MISSING[q], orders[q]))


# Rows


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows with the faults that crc32 of conv_id:turn modulo 20 stands for; nulls are one space.

    0 drops a row, 1 empties its text, 2 takes . ! ? out of it, 3 repeats the row and 4 makes its role user. Rows that are
    equal afterwards are one with their number.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(word("role"))
    made = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", fault.alias("fault")).where("fault <> 0")
    made = made.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).cast("long").alias("n"))
    return made.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("copies"))


def symbols(role: Column, text: Column) -> Column:
    """The row as the search sees it if nothing like it was seen earlier."""
    initial = F.when(F.substring(role, 1, 1).isin("s", "u", "a"), F.substring(role, 1, 1)).otherwise("o")
    cut = ~text.rlike(f"[.!?][{SPACE}]*\\z")
    return F.when(~text.rlike(f"[^{SPACE}]"), GONE).when(cut, F.upper(initial)).otherwise(initial)


def numbered(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault, symbol, seq: all rows in order, by conversation, turn (nulls first), role and text.

    Conversations are cut over sorted partitions wherever these end, so none of them has to fit one task. A text that a
    conversation's role has said at an earlier turn, or before at the same one, is a duplicate.
    """
    key = ["conv_id", "role", "hash"]
    hashed = rows.withColumn("hash", F.sha2("text", 256))
    first = hashed.groupBy(*key).agg(F.min(F.struct(F.col("turn").isNotNull(), "turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("hash").alias("h"), F.col("first.turn").alias("first"))
    seen = hashed.join(first, hashed["conv_id"].eqNullSafe(first["c"]) & (hashed["role"] == first["r"]) & (hashed["hash"] == first["h"])).withColumn("again", ~F.col("turn").eqNullSafe(F.col("first")))
    symbol = symbols(F.col("role"), F.col("text"))
    fault = F.when(symbol == GONE, "blank").when(F.col("again"), "duplicate").when(symbol != F.lower(symbol), "truncated")
    each = seen.select("conv_id", "turn", "role", "text", fault.alias("fault"), F.when(F.col("again"), GONE).otherwise(symbol).alias("symbol"), "copies")
    # Copies of a row follow it at once; all but the first are duplicates, or as blank as it.
    more = each.where("copies > 1").select("conv_id", "turn", "role", "text", F.when(F.col("fault") == "blank", "blank").otherwise("duplicate").alias("fault"), F.lit(GONE).alias("symbol"), F.explode(F.sequence(F.lit(2), "copies")).alias("copy"))
    every = each.drop("copies").withColumn("copy", F.lit(1).cast("long")).unionByName(more)
    order = ["conv_id", "turn", "role", "text", "copy"]
    ordered = every.repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.drop("copy").withColumn("seq", F.monotonically_increasing_id())


def block(bits: int) -> Column:
    return F.shiftright("seq", bits)


def collected(df: DataFrame, at: Column, *columns: str) -> DataFrame:
    """conv_id, at, parts: rows of df with one value of at, a bounded number, in the order of their columns."""
    return df.groupBy("conv_id", at.alias("at")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("parts"))


# Search


def audits(rows: DataFrame, bits: int = BLOCK, group: int = GROUP) -> DataFrame:
    """conv_id, block, audit, entry, last: the edits of each block of rows (conv_id, seq, symbol) of 2 ** bits sequence numbers at most.

    The audit of a conversation's last block holds the rows that are inserted at its end.
    """
    blocks = materialise(collected(rows, block(bits), "seq", "symbol").select("conv_id", F.col("at").alias("block"), F.array_join("parts.symbol", "").alias("rows")), "blocks")
    many = blocks.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    several = many.where("n > 1").select(F.col("conv_id").alias("c"))
    same = lambda a, b: a["conv_id"].eqNullSafe(b["c"])
    alone = blocks.join(several, same(blocks, several), "left_anti")
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def whole(columns):
        yield [columns[0], columns[1], [search(r, START, True)[START][1] for r in columns[2]], [START] * len(columns[0]), [True] * len(columns[0])]

    made = map_rows(alone, whole, f"conv_id {id_type}, block long, audit string, entry int, last boolean")
    cut = blocks.join(several, same(blocks, several), "left_semi")

    def leaves(columns):
        yield [columns[0], columns[1], *map(list, zip(*map(matrix, columns[2]), strict=True))]

    leaf = materialise(map_rows(cut, leaves, f"conv_id {id_type}, block long, costs array<long>, orders array<int>, audits array<string>"), "matrices")
    # Up: groups of matrices become one, until a conversation's matrices fit one group.
    levels, now = [], leaf.select("conv_id", F.col("block").alias("at"), "costs", "orders")
    while True:
        most = now.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
        top = most <= 1 << group
        parts = collected(now.withColumnRenamed("at", "node"), F.lit(0) if top else F.shiftright("node", group), "node", "costs", "orders")

        def joined(columns):
            out = ([], [], [], [], [], [])
            for conv, at, parts in zip(*columns, strict=True):
                costs, orders, between = chain([(p["costs"], p["orders"]) for p in parts])
                for o, x in zip(out, (conv, at, costs, orders, [p["node"] for p in parts], between), strict=True):
                    o.append(x)
            yield list(out)

        now = materialise(map_rows(parts, joined, f"conv_id {id_type}, at long, costs array<long>, orders array<int>, nodes array<long>, between array<array<int>>", rows=64), "matrices")
        levels.append(now)
        if top:
            break

    # Down: the best way through the top, then through each of its parts.
    def ends(columns):
        yield [columns[0], columns[1], [START] * len(columns[0]), [best_end(c, o) for c, o in zip(columns[2], columns[3], strict=True)], [True] * len(columns[0])]

    chosen = map_rows(now.select("conv_id", "at", "costs", "orders"), ends, f"conv_id {id_type}, at long, entry int, exit int, last boolean")
    for level in reversed(levels):
        to = chosen.select(F.col("conv_id").alias("c"), F.col("at").alias("a"), "entry", "exit", "last")

        def parted(columns):
            out = ([], [], [], [], [])
            for conv, nodes, between, entry, exit_, last in zip(*columns, strict=True):
                steps = ways(entry, exit_, between)
                for k, (node, (p, q)) in enumerate(zip(nodes, steps, strict=True)):
                    for o, x in zip(out, (conv, node, p, q, last and k == len(nodes) - 1), strict=True):
                        o.append(x)
            yield list(out)

        both = level.join(to, same(level, to) & (level["at"] == to["a"])).select("conv_id", "nodes", "between", "entry", "exit", "last")
        chosen = materialise(map_rows(both, parted, f"conv_id {id_type}, at long, entry int, exit int, last boolean", rows=64), "ways")
    to = chosen.select(F.col("conv_id").alias("c"), "at", "entry", "exit", "last")
    end = F.repeat(F.lit("I"), F.element_at(F.array(*map(F.lit, MISSING)), F.col("exit") + 1))
    audit = F.concat(F.element_at("audits", 4 * F.col("entry") + F.col("exit") + 1), F.when(F.col("last"), end).otherwise(""))
    return made.unionByName(leaf.join(to, same(leaf, to) & (leaf["block"] == to["at"])).select("conv_id", "block", audit.alias("audit"), "entry", "last"))


def edits_of(audit: str) -> list[str]:
    """The audit cut behind each edit that takes a row: "IKDI" is "IK", "D" and "I"."""
    out, start = [], 0
    for k, x in enumerate(audit):
        if x != "I":
            out.append(audit[start : k + 1])
            start = k + 1
    return [*out, audit[start:]]


class Repaired:
    """The fold over one conversation's rows in order."""

    def __init__(self):
        self.q, self.digest, self.rows, self.audit = START, hashlib.sha256(), 0, []
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.cost = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None

    def emit(self, role: str, text: str) -> None:
        self.digest.update(("\n" * (self.rows > 0) + role + ":" + text).encode())
        self.rows += 1

    def inserted(self, edits: str) -> None:
        for _ in range(edits.count("I")):
            x = MADE[self.q]
            self.emit(ROLE[x], "")
            self.q = NEXT[self.q][x]
            self.cost += INSERT

    def take(self, turn: int | None, role: str, text: str, fault: str | None, edits: str) -> None:
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = initial
        if turn is not None:
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if fault is not None:
            self.counts[fault] += 1
        self.audit.append(edits)
        self.inserted(edits)
        charge = CHARGE if fault == "truncated" else 0
        if edits[-1] == "D":
            self.cost += DELETE
        elif edits[-1] == "K":
            self.cost += charge
            self.q = NEXT[self.q][initial]
            self.emit(role, text)
        else:
            self.cost += REROLE + charge
            x = MADE[self.q]
            self.q = NEXT[self.q][x]
            self.emit(ROLE[x], text)

    def row(self, rest: str) -> tuple:
        self.audit.append(rest)
        self.inserted(rest)
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        return gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest()


REPAIR = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair(conversations: DataFrame, bits: int = BLOCK, group: int = GROUP) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id after `damaged`.

    A null conv_id is a conversation of its own. Rows of one turn go by role and text, so a repeated row stands beside itself; a
    null turn comes first and is in no gap. Roles are told by their first character; texts of any length are kept whole. A
    conversation whose rows are all dropped has zeros, an empty audit and the digest of an empty text. An empty
    table has no rows; other columns are ignored.
    """
    rows = materialise(numbered(damaged(conversations)), "rows")
    found = audits(rows, bits, group).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "audit", "last")
    # The rows of a block meet its edits, and each conversation streams by in order.
    with_edits = rows.withColumn("block", block(bits)).join(found, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")))
    order = ["conv_id", "seq"]
    streamed = with_edits.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault", "block", "audit")
    id_type = conversations.schema["conv_id"].dataType.simpleString()
    from pyspark.sql.types import StructType

    out = StructType.fromDDL(f"conv_id {id_type}, {REPAIR}")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        now, conv, at, edits, k = None, None, None, [], 0

        def made(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        done = []
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                for c, turn, role, text, fault, b, audit in zip(*(x.to_pylist() for x in batch.slice(start, 512).columns), strict=True):
                    if now is None or c != conv:
                        if now is not None:
                            done.append((conv, *now.row(edits[-1])))
                        now, conv, at = Repaired(), c, None
                    if b != at:
                        at, edits, k = b, edits_of(audit), 0
                    now.take(turn, role, text, fault, edits[k])
                    k += 1
            if done:
                yield made(done)
                done = []
        if now is not None:
            yield made([(conv, *now.row(edits[-1]))])

    made = streamed.mapInArrow(folded, out)
    empty = hashlib.sha256(b"").hexdigest()
    everyone = conversations.select(F.col("conv_id").alias("id")).distinct()
    both = everyone.join(made, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    rest = [F.coalesce(f.name, F.lit({"audit": "", "repaired_sha256": empty}.get(f.name, 0))).cast(f.dataType).alias(f.name) for f in out.fields[1:]]
    return both.select(F.col("id").alias("conv_id"), *rest)


def _oracle() -> str:
    """The same by a dynamic programme over (cost, audit) of each state, a step of recursion for each row."""
    add = lambda s, cost, edit: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}'}}"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    keep = lambda s, x: add(s, f"charge + CASE WHEN initial = '{x}' THEN 0 ELSE 1000000000 END", "K")
    reroled = lambda s: add(s, "charge + 1", "R")
    gone = lambda s: add(s, 2, "D")
    user = least("s2", add("s0", 5, "I"), add("s1", 5, "I"), add("s3", 5, "I"))
    never = "{'c': 1000000000::bigint, 'a': ''}"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda x: ord(x)::bigint) AS b FROM conversations),
crc AS (SELECT *, xor(list_reduce(flatten(list_transform(b, lambda x: list_transform(range(0, 8), lambda j: (x >> j::int) & 1))),
  lambda c, d: xor(c >> 1, 3988292384 * (xor(c, d) & 1)), 4294967295::bigint), 4294967295::bigint) % 20 AS fault FROM k),
hurt AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE fault <> 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again FROM ordered),
faults AS (SELECT *, left(role, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
  WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS f FROM seen),
sym AS (SELECT *, CASE f WHEN '' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000 END AS charge, lag(initial) OVER (PARTITION BY conv_id ORDER BY n) || initial AS two FROM faults),
dp AS (SELECT DISTINCT conv_id, 0::bigint AS i, {{'c': 0::bigint, 'a': ''}} AS s0, {never} AS s1, {never} AS s2, {never} AS s3 FROM sym
  UNION ALL SELECT conv_id, n, {gone('s0')}, {least(gone('s1'), keep('s0', 's'))},
    {least(gone('u'), keep('s0', 'u'), keep('s1', 'u'), keep('a', 'u'), reroled('s0'), reroled('s1'), reroled('a'))}, {least(gone('a'), keep('u', 'a'), reroled('u'))}
  FROM (SELECT *, {least('s3', add('u', 5, 'I'))} AS a FROM (SELECT dp.*, n, charge, initial, {user} AS u
    FROM dp JOIN sym ON sym.conv_id IS NOT DISTINCT FROM dp.conv_id AND sym.n = dp.i + 1))),
ends AS (SELECT conv_id, {least('s0', least('s3', add('u', 5, 'I')))} AS best FROM (SELECT *, {user} AS u
  FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1)),
steps AS (SELECT conv_id, j, substr(best.a, j, 1) AS edit FROM ends, LATERAL (SELECT unnest(range(1, length(best.a) + 1)) AS j)),
placed AS (SELECT *, count(*) FILTER (edit <> 'I') OVER w AS n, count(*) FILTER (edit <> 'D') OVER w AS p FROM steps WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
made AS (SELECT placed.conv_id, j, p, edit, role, text, max(CASE WHEN p = 1 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY placed.conv_id) AS led
  FROM placed LEFT JOIN sym ON sym.conv_id IS NOT DISTINCT FROM placed.conv_id AND sym.n = placed.n WHERE edit <> 'D'),
texts AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (p - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS whole FROM made GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (f = 'blank') AS blank, count(*) FILTER (f = 'duplicate') AS duplicate,
  count(*) FILTER (f = 'truncated') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM sym GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLE_SQL = _oracle()
