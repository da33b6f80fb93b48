"""Repair of the structure of conversations by depth-first branch and bound.

A conversation shall be empty or run ``(system)? (user assistant)+``.  Its rows, in the order of their turns, are kept
(free), given the role user or assistant (1), deleted (2) or joined by an inserted row without text (5); a truncated row
that is not deleted adds 5; blank rows and repeats must be deleted.  Wanted is the cheapest list of edits and, among
those, the one whose letters (D, I, K, R) come first in ASCII.

The search goes depth first over an explicit stack.  A node is (rows used, state of the pattern); its edits are tried in
the order of their letters.  Three things cut a prefix off: a suffix lower bound (the least cost of the remaining rows when
the end of the pattern is let open, computed backwards once) together with the incumbent (cost, audit), which a dive
along the bounds gives to begin with; and a dominance table that holds each node's least cost so far.  As prefixes
come in ASCII order, a later one of equal cost is a worse one.  The bound is off by the end of the pattern alone, so a
node is opened a few times at most and the work stays in proportion to the rows.

On Spark: the faults of a row are Column expressions.  A first shuffle brings narrow rows (no text) of a conversation
together, where it is searched; the edits are written out.  A second shuffle merges edits and texts in order, and a
task streams through them holding one text at a time.  A conversation is one task's, as its repaired form is one
sequence, and needs some 200 bytes a row there; texts are never collected.

Edge cases: NULL role or text counts as one space (no legal role; blank); a role without a first letter can not be kept;
rows of a NULL ``conv_id`` form a conversation; NULL turns come first; rows of one turn are ordered by role, then by a digest
of role and text, and equal rows stand together; a conversation without rows is empty, and right; an empty table
gives no row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediafold.llm.common import map_arrow, stored

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
DELETE, INSERT, REROLE, CUT_OFF = 2, 5, 1, 5
# States of the pattern: nothing yet, behind the system row, behind a user row, behind an assistant row.
START, SYSTEM, USER, ASSISTANT = 0, 1, 2, 3
DUE = ("u", "u", "a", "u")
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
NO_COST = 1 << 60

SPACES = " \t\n\x0b\x0c\r"
ORDER = ("conv_id", "part", "turn", "role", "digest", "kind", "seq")
SUMMARY = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
PLAN_SCHEMA = ("conv_id long, part int, turn long, role string, digest string, kind int, seq long, edit string, "
               "new_role string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")
ROWS_SCHEMA = "conv_id long, position long, role string, text string"
DIGEST_SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
                 "audit string, repaired_sha256 string")
OUT_BYTES = 4 << 20


# ------------------------------------------------------------------ search
def suffix_bounds(initials, gone, extra) -> list[array]:
    """Lower bounds of the cost of the rows from each one on, by state, with the end of the pattern left open."""
    n = len(initials)
    start, user, assistant = (array("q", bytes(8 * (n + 1))) for _ in range(3))  # nothing yet; due: user, assistant
    for i in range(n - 1, -1, -1):
        s, u, a = start[i + 1] + DELETE, user[i + 1] + DELETE, assistant[i + 1] + DELETE
        if not gone[i]:
            as_user = assistant[i + 1] + extra[i] + (initials[i] != "u") * REROLE
            s, u = min(s, as_user), min(u, as_user)
            a = min(a, user[i + 1] + extra[i] + (initials[i] != "a") * REROLE)
            if initials[i] == "s":
                s = min(s, user[i + 1] + extra[i])
        assistant[i] = min(a, u + INSERT)
        user[i] = min(u, a + INSERT)
        start[i] = min(s, a + INSERT)
    return [start, user, assistant, user]


def edits_of(i, state, initials, gone, extra) -> list[tuple[str, int, int, int]]:
    """(letter, next row, next state, cost) of the edits at a node, in ASCII order."""
    more = i < len(initials)
    found = [("D", i + 1, state, DELETE)] if more else []
    found.append(("I", i, NEXT[state], INSERT))
    if more and not gone[i]:
        if initials[i] == DUE[state]:
            found.append(("K", i + 1, NEXT[state], extra[i]))
        else:
            if state == START and initials[i] == "s":
                found.append(("K", i + 1, SYSTEM, extra[i]))
            found.append(("R", i + 1, NEXT[state], REROLE + extra[i]))
    return found


def dive(initials, gone, extra, bounds) -> tuple[int, str]:
    """A first incumbent: always the edit of the least bound, never two insertions ahead of a row."""
    i, state, cost, audit = 0, START, 0, []
    while i < len(initials) or state not in (START, ASSISTANT):
        twice = audit[-1:] == ["I"] and i < len(initials)
        options = [e for e in edits_of(i, state, initials, gone, extra) if not (twice and e[0] == "I")]
        letter, i, state, step = min(options, key=lambda e: e[3] + bounds[e[2]][e[1]])
        cost += step
        audit.append(letter)
    return cost, "".join(audit)


def cheapest_edits(initials: list[str], faults: list[int]) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of rows with these role initials and first faults."""
    gone = [f in (BLANK, DUPLICATE) for f in faults]
    extra = [CUT_OFF if f == TRUNCATED else 0 for f in faults]
    bounds = suffix_bounds(initials, gone, extra)
    best_cost, best_audit = dive(initials, gone, extra, bounds)
    reached = False  # the incumbent of the dive may be one of several of its cost
    least = array("q", [NO_COST]) * (4 * (len(initials) + 1))
    path: list[str] = []
    stack = [(0, START, 0, 0, "")]
    while stack:
        i, state, cost, depth, letter = stack.pop()
        bound = cost + bounds[state][i]
        if bound > best_cost or (reached and bound == best_cost) or least[4 * i + state] <= cost:
            continue
        least[4 * i + state] = cost
        if depth:
            del path[depth - 1:]
            path.append(letter)
        if i == len(initials) and state in (START, ASSISTANT):
            best_cost, best_audit, reached = cost, "".join(path), True
            continue
        for letter, to, then, step in reversed(edits_of(i, state, initials, gone, extra)):
            stack.append((to, then, cost + step, depth + 1, letter))
    return best_cost, best_audit


def new_roles(initials: list[str], audit: str) -> Iterator[tuple[str, int, str | None]]:
    """(letter, row, role) of each edit: the role that it gives, None where a row keeps its own or goes."""
    i, state = 0, START
    for letter in audit:
        role = ROLE[DUE[state]] if letter in "IR" else None
        yield letter, i, role
        if letter != "D":
            state = SYSTEM if letter == "K" and initials[i] == "s" else NEXT[state]
        i += letter != "I"


def diagnose(turns, roles, digests, blank, cut) -> dict:
    """Faults of the rows of a conversation, in order, and its cheapest repair."""
    seen, faults = set(), []
    for d, b, c in zip(digests, blank, cut, strict=True):
        faults.append(BLANK if b else DUPLICATE if d in seen else TRUNCATED if c else 0)
        seen.add(d)
    initials = [r[:1] for r in roles]
    known = [t for t in turns if t is not None]
    cost, audit = cheapest_edits(initials, faults)
    return {
        "gaps": max(known) - min(known) + 1 - len(set(known)) if known else 0,
        "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
        "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:], strict=False)),
        "cost": cost, "audit": audit,
    }


# ------------------------------------------------------------------- Spark
def _key(conversations: DataFrame) -> list[Column]:
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
            F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
            text.alias("text")]


_FACTS = ("conv_id", "turn", "role", "digest", "present", "blank", "cut")
PLAN_ROWS = 20_000


def _conversations(batches) -> Iterator[tuple[int | None, list[tuple]]]:
    """(conv_id, its rows as tuples of ``_FACTS``) from narrow rows that are sorted by conversation."""
    held, conv = [], None
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _FACTS), strict=True):
            if held and row[0] != conv:
                yield conv, held
                held = []
            conv = row[0]
            held.append(row)
    if held:
        yield conv, held


def _plans(batches):
    """Summary and edits of every conversation from its narrow rows, sorted."""
    none, out = (None,) * len(SUMMARY), []
    for conv, group in _conversations(batches):
        group = [r for r in group if r[4]]
        _, turns, roles, digests, _, blank, cut = zip(*group, strict=True) if group else ((),) * len(_FACTS)
        said = diagnose(turns, roles, digests, blank, cut)
        out.append((conv, 0, None, None, None, 0, 0, None, None, *(said[c] for c in SUMMARY)))
        for seq, (letter, i, role) in enumerate(new_roles([r[:1] for r in roles], said["audit"])):
            i = min(i, len(turns) - 1)
            out.append((conv, 1, turns[i], roles[i], digests[i], 1, seq, letter, role, *none))
            if len(out) >= PLAN_ROWS:
                yield _batch(out, _PLAN)
                out = []
    if out:
        yield _batch(out, _PLAN)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}


def _arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, _TYPES[kind]) for name, kind in (f.split() for f in schema.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), schema, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in columns], schema=schema)


_PLAN, _ROWS, _DIGEST = _arrow(PLAN_SCHEMA), _arrow(ROWS_SCHEMA), _arrow(DIGEST_SCHEMA)


def plan(conversations: DataFrame) -> DataFrame:
    """Summary (``part`` 0) and edits (``part`` 1) of each conversation.

    ``conversations`` has ``conv_id, turn, role, text`` and may have ``present`` (false: the conversation is known, this
    row is not part of it).
    """
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    rows = conversations.select(*_key(conversations), present.alias("present"))
    end = F.rtrim("text", F.lit(SPACES))
    narrow = rows.select("conv_id", "turn", "role", "digest", "present", (end == "").alias("blank"),
                         (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    narrow = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest")
    return stored(map_arrow(narrow, _plans, PLAN_SCHEMA), "repair-plan")


def _merged(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """Edits and texts of each conversation in order: ahead of the edits of a row (or of its equals) comes its text."""
    present = F.col("present") if "present" in conversations.columns else F.lit(True)
    texts = conversations.where(present).select(
        *_key(conversations), F.lit(1).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"))
    both = plans.withColumn("text", F.lit(None).cast("string")).unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*ORDER)


_MERGED = ("part", "kind", "edit", "new_role", "role", "text")


def _repaired(batches) -> Iterator[tuple]:
    """((conv_id, *SUMMARY), None, None) for each conversation, then (None, role, text) for each row of its repaired form."""
    text = None
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in _MERGED]
        summaries = None
        for i, (part, kind, edit, new_role, role, own) in enumerate(zip(*columns, strict=True)):
            if part == 0:
                if summaries is None:
                    summaries = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", *SUMMARY)]
                yield tuple(c[i] for c in summaries), None, None
            elif kind == 0:
                text = own
            elif edit != "D":
                yield None, new_role or role, "" if edit == "I" else text


def repaired_rows(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired conversations: ``conv_id, position, role, text``; an empty one has no row."""
    def run(batches):
        out, size, conv, position = [], 0, None, 0
        for found, role, text in _repaired(batches):
            if found is not None:
                conv, position = found[0], 0
                continue
            out.append((conv, position, role, text))
            position, size = position + 1, size + len(text) + 64
            if size > OUT_BYTES:
                yield _batch(out, _ROWS)
                out, size = [], 0
        if out:
            yield _batch(out, _ROWS)
    return map_arrow(_merged(conversations, plans), run, ROWS_SCHEMA)


def repair_digests(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """Faults, cost and audit of each conversation, and SHA-256 of its repaired ``role:text`` lines."""
    def run(batches):
        out, summary, sha, lines = [], None, None, 0
        for found, role, text in _repaired(batches):
            if found is not None:
                if summary is not None:
                    out.append((*summary, sha.hexdigest()))
                if len(out) >= PLAN_ROWS:
                    yield _batch(out, _DIGEST)
                    out = []
                summary, sha, lines = found, hashlib.sha256(), 0
                continue
            sha.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
            lines += 1
        if summary is not None:
            out.append((*summary, sha.hexdigest()))
        if out:
            yield _batch(out, _DIGEST)
    return map_arrow(_merged(conversations, plans), run, DIGEST_SCHEMA)


# ------------------------------------------------------------------ damage
def damaged(conversations: DataFrame) -> DataFrame:
    """Rows damaged by the crc32 of ``conv_id:turn`` modulo 20 (NULLs: one space).

    0 drops a row (``present`` false), 1 empties its text, 2 removes its full stops, exclamation and question marks, 3
    repeats it, 4 gives it the role user.
    """
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), space))
    fate = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return conversations.select(
        "conv_id", "turn", F.when(fate == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fate != 0).alias("present"),
        F.explode(F.when(fate == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
