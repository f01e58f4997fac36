r"""Repair of the structure of conversations: the cheapest edits that make the roles an optional system turn and pairs of user and
assistant turns.

Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2 (blank and repeated turns must go), Insert of an empty user or
assistant turn 5; a truncated turn that stays costs 5 more.  The grammar has four states: nothing yet, after the system turn,
after a user turn, after a pair.  A backward pass gives each turn the cost to go of every state behind it, by dynamic
programming; a forward walk from the first state then takes, of the edits that are tight with these costs, the one whose
initial is least in ASCII (D, I, K, R).

Conversations are dealt by conv_id in one exchange and sorted; both passes stream over the sorted rows and hold four numbers
or one state, so no task holds a conversation, however long.  A long one still passes one task, as the digest of its repaired text
is one sequential hash.

Defined cases: a null role or text is one space; turns come by turn (nulls first), then role, then text, and repeated rows stay,
as repeats; a null conv_id is one conversation; the initial of an empty role is none, so such a turn can't be kept as it is; other
columns are ignored; texts of any length are whole; an empty table gives no row.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mensura.llm.common import tune

SPACES = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 60
#: Grammar: states 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after a pair.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ROLE_DUE, NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
REPAIRED = "conv_id long, at long, turn long, was string, role string, text string, fault string, edit string, cost long"


def inserted(costs: list[int]) -> list[int]:
    """Costs to go when turns may be inserted first."""
    c = list(costs)
    for _ in range(2):  # two insertions lead back to where they began
        for q in range(4):
            c[q] = min(c[q], INSERT + c[NEXT[q]])
    return c


END = inserted([0, FAR, FAR, 0])


def choices(q: int, initial: str, fault: str | None, after) -> list[tuple[int, str, int]]:
    """(cost to go, edit, next state) of the edits that use up a turn, in ASCII order of their initials."""
    out = [(DELETE + after[q], "D", q)]
    if fault not in ("blank", "duplicate"):
        extra = TRUNCATED if fault == "truncated" else 0
        if (q, initial) in STEPS:
            to = STEPS[q, initial]
            out.append((KEEP + extra + after[to], "K", to))
        out.append((REROLE + extra + after[NEXT[q]], "R", NEXT[q]))
    return out


def before(initial: str, fault: str | None, after) -> list[int]:
    return inserted([min(c[0] for c in choices(q, initial, fault, after)) for q in range(4)])


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone, nth, fault), dealt by conversation: nth counts what has the same role and text in it."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in conversations.columns else F.lit(False)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), gone.alias("gone")).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    kept = F.rtrim("text", F.lit(SPACES))
    ends = kept.endswith(".") | kept.endswith("!") | kept.endswith("?")
    fault = F.when(kept == "", "blank").when(F.col("nth") > 1, "duplicate").when(~ends, "truncated")
    return rows.withColumn("nth", nth).withColumn("fault", F.when(~F.col("gone"), fault))


def _backward(batches):
    """Adds `after`, the costs to go of the four states behind each row, to rows that come last first."""
    import pyarrow as pa

    conv, costs = (), END
    for batch in batches:
        out = []
        for c, role, gone, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "gone", "fault")), strict=True):
            if c != conv:
                conv, costs = c, END
            out.append(costs)
            if not gone:
                costs = before(role[:1], fault, costs)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "after"])


def _forward(batches):
    """The walk over rows in order: REPAIRED."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
    names = [c.split()[0] for c in REPAIRED.split(", ")]
    rows: list = []
    conv, state, at = (), 0, 0

    def insert() -> None:
        nonlocal state, at
        rows.append((conv, at, None, None, ROLE_DUE[state], "", None, "I", INSERT))
        state, at = NEXT[state], at + 1

    def close() -> None:
        while conv != () and END[state]:
            insert()

    for batch in batches:
        for c, turn, role, text, gone, fault, after in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "gone", "fault", "after")), strict=True):
            if c != conv:
                close()
                conv, state, at = c, 0, 0
            if gone:
                rows.append((conv, at, turn, role, None, None, None, None, 0))
                at += 1
                continue
            costs = before(role[:1], fault, after)
            while True:
                own = choices(state, role[:1], fault, after)
                if own[0][0] != costs[state] and INSERT + costs[NEXT[state]] == costs[state]:
                    insert()
                    continue
                go, edit, to = next(x for x in own if x[0] == costs[state])
                rows.append((conv, at, turn, role, None if edit == "D" else role if edit == "K" else ROLE_DUE[state], text, fault, edit, go - after[to]))
                state, at = to, at + 1
                break
        if len(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows.clear()
    close()
    if len(rows):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def repair(conversations: DataFrame) -> DataFrame:
    """A row for each turn and each inserted one: conv_id, at (the order), turn, was (its role before), role, text, fault, edit, cost.

    What stays has a role; a deleted turn has none, but its text.  Of a column `gone`, rows where it holds take no part (and have no
    edit), but their conversation stays in the result.  The rows of a conversation stand together, in order.
    """
    tune(conversations.sparkSession)
    rows = ordered(conversations)
    turn = F.col("turn")
    last_first = rows.sortWithinPartitions("conv_id", turn.desc_nulls_last(), F.desc("role"), F.desc("text"), F.desc("nth"))
    costed = last_first.mapInArrow(_backward, "conv_id long, turn long, role string, text string, gone boolean, nth int, fault string, after array<long>")
    return costed.sortWithinPartitions("conv_id", turn.asc_nulls_first(), "role", "text", "nth").mapInArrow(_forward, REPAIRED)


def damage(conversations: DataFrame) -> DataFrame:
    """Deals faults to rows by a hash of conversation and turn; a dropped row stays as `gone`."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    said = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), "text": said, "gone": F.col("kind") == 0})
    return rows.withColumn("n", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("n", "kind")


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _digest(batches):
    """One row for each conversation, from the rows of repair() in their order."""
    import pyarrow as pa

    kinds = [pa.int64()] * 7 + [pa.string()] * 2
    names = [c.split()[0] for c in DIGEST.split(", ")]
    conv: object = ()
    done: list = []

    def fresh():
        return {"first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "any": False, "before": None}

    own = fresh()

    def close() -> None:
        if conv != ():
            gaps = own["last"] - own["first"] + 1 - own["turns"] if own["turns"] else 0
            done.append((conv, min(gaps, (1 << 63) - 1), own["blank"], own["duplicate"], own["truncated"], own["illegal"], own["cost"], "".join(own["audit"]), own["sha"].hexdigest()))

    for batch in batches:
        for c, turn, was, role, text, fault, edit, cost in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "was", "role", "text", "fault", "edit", "cost")), strict=True):
            if c != conv:
                close()
                conv, own = c, fresh()
            if edit is None:
                continue
            own["audit"].append(edit)
            own["cost"] += cost
            if edit != "I":
                if turn is not None and turn != own["last"]:
                    own["turns"] += 1
                    own["first"] = turn if own["first"] is None else own["first"]
                    own["last"] = turn
                if fault:
                    own[fault] += 1
                own["illegal"] += own["before"] is not None and own["before"] + was[:1] not in ("su", "ua", "au")
                own["before"] = was[:1]
            if role is not None:
                own["sha"].update(f"{chr(10) if own['any'] else ''}{role}:{text}".encode())
                own["any"] = True
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
    close()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)


def digest(repaired: DataFrame) -> DataFrame:
    """Faults, costs, edits and a hash of the repaired turns for each conversation of repair()'s rows."""
    return repaired.mapInArrow(_digest, DIGEST)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))))


def op12_sql() -> str:
    """The damage, both passes and the digest with recursive queries; CRC-32 from its polynomial."""
    spaces = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    step = lambda q, to, c: f"CASE WHEN ok AND ini = '{c}' THEN pen + c{to} ELSE 1000000000 END"
    return f"""WITH RECURSIVE bits AS (
  SELECT i AS byte, CAST(i AS BIGINT) AS v, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT byte, xor(v >> 1, 3988292384 * (v & 1)), k + 1 FROM bits WHERE k < 8
), crc AS MATERIALIZED (SELECT list(v ORDER BY byte) AS tab FROM bits WHERE k = 8),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hit AS MATERIALIZED (
  SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda h, b: xor(h >> 8, tab[CAST(xor(h, b) & 255 AS INTEGER) + 1])), 4294967295) % 20 AS kind FROM src, crc
), dam AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS nth
  FROM hit WHERE kind <> 0
), num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS rn, rtrim(text, {spaces}) AS cut FROM dam
), flt AS MATERIALIZED (
  SELECT conv_id, turn, role, text, rn, substr(role, 1, 1) AS ini, cut = '' AS blank,
    cut <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY rn) > 1 AS dup, cut <> '' AND right(cut, 1) NOT IN ('.', '!', '?') AS tru,
    lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY rn) AS prev FROM num
), e AS MATERIALIZED (SELECT *, NOT blank AND NOT dup AS ok, CASE WHEN tru THEN {TRUNCATED} ELSE 0 END AS pen FROM flt),
n AS MATERIALIZED (SELECT c.conv_id, coalesce(max(rn), 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN e ON e.conv_id = c.conv_id GROUP BY 1),
bw AS (
  SELECT conv_id, n AS i, 0 AS c0, 10 AS c1, 5 AS c2, 0 AS c3 FROM n
  UNION ALL
  SELECT conv_id, i, least(b0, 5 + e2) AS c0, least(b1, 5 + e2) AS c1, e2 AS c2, least(b3, 5 + e2) AS c3 FROM (
    SELECT *, least(b2, 5 + b3) AS e2 FROM (
      SELECT bw.conv_id, i - 1 AS i,
        least(2 + c0, {step(0, 1, 's')}, {step(0, 2, 'u')}, CASE WHEN ok THEN 1 + pen + c2 ELSE 1000000000 END) AS b0,
        least(2 + c1, {step(1, 2, 'u')}, CASE WHEN ok THEN 1 + pen + c2 ELSE 1000000000 END) AS b1,
        least(2 + c2, {step(2, 3, 'a')}, CASE WHEN ok THEN 1 + pen + c3 ELSE 1000000000 END) AS b2,
        least(2 + c3, {step(3, 2, 'u')}, CASE WHEN ok THEN 1 + pen + c2 ELSE 1000000000 END) AS b3
      FROM bw JOIN e ON e.conv_id = bw.conv_id AND e.rn = bw.i))
), togo AS MATERIALIZED (SELECT conv_id, i, [c0, c1, c2, c3] AS c FROM bw),
fw AS (
  SELECT conv_id, 0 AS i, 0 AS q, '' AS audit, [] :: VARCHAR[] AS kept FROM n
  UNION ALL
  SELECT conv_id, i + CASE WHEN ed = 'I' THEN 0 ELSE 1 END, CASE WHEN ed = 'D' THEN q WHEN ed = 'K' AND ini = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END, audit || ed,
    CASE ed WHEN 'D' THEN kept WHEN 'K' THEN list_append(kept, role || ':' || text)
      ELSE list_append(kept, CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END || CASE WHEN ed = 'R' THEN text ELSE '' END) END
  FROM (
    SELECT fw.*, e.role, e.text, e.ini, CASE
      WHEN a.c IS NOT NULL AND 2 + a.c[q + 1] = b.c[q + 1] THEN 'D'
      WHEN 5 + b.c[CASE WHEN q = 2 THEN 4 ELSE 3 END] = b.c[q + 1] THEN 'I'
      WHEN ok AND (q <> 2 AND ini = 'u' AND pen + a.c[3] = b.c[q + 1] OR q = 2 AND ini = 'a' AND pen + a.c[4] = b.c[q + 1] OR q = 0 AND ini = 's' AND pen + a.c[2] = b.c[q + 1]) THEN 'K'
      ELSE 'R' END AS ed
    FROM fw JOIN n USING (conv_id) JOIN togo b ON b.conv_id = fw.conv_id AND b.i = fw.i
      LEFT JOIN togo a ON a.conv_id = fw.conv_id AND a.i = fw.i + 1 LEFT JOIN e ON e.conv_id = fw.conv_id AND e.rn = fw.i + 1
    WHERE fw.i < n.n OR b.c[q + 1] > 0)
), f AS (SELECT conv_id, fw.i, audit, kept, c[q + 1] AS rest, n.n FROM fw JOIN n USING (conv_id) JOIN togo USING (conv_id, i)),
agg AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate, count(*) FILTER (tru AND NOT dup) AS truncated,
    count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY 1
)
SELECT n.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
  CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(t.c[1] AS BIGINT) AS cost, f.audit,
  sha256(array_to_string(f.kept, chr(10))) AS repaired_sha256
FROM n JOIN togo t ON t.conv_id = n.conv_id AND t.i = 0 JOIN f ON f.conv_id = n.conv_id AND f.i = f.n AND f.rest = 0 LEFT JOIN agg ON agg.conv_id = n.conv_id"""
