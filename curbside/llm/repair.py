"""Repair of the turn structure of conversations by depth-first branch-and-bound."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from curbside.sources.staging import stage

BLANK = r"\x20\x09-\x0D"
#: Turns that one search looks at.
CHUNK = 64
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
#: What has been put out: nothing, a system turn, a user turn, an assistant turn.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that an inserted or reroled one becomes.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = (None, None, "user", "assistant")
#: Inserts that complete what ends in a state.
TRAIL = ("", "II", "I", "")
KEPT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
EXITS = ((NOTHING, SYSTEM, USER, ASSISTANT), (SYSTEM, USER, ASSISTANT), (USER, ASSISTANT), (USER, ASSISTANT))

CONVERSATION = ["conv_id", "nameless"]
#: A turn's place: turns without a number come first; then role and digest of the text break ties.
PLACE = ["numbered", "turn", "role", "digest"]
PIECE = "conv_id bigint, nameless boolean, segment int"
COUNTS = ["blank", "duplicate", "truncated", "illegal"]


def _seeds(signs: str, entry: int) -> list[float]:
    """For each exit the cost of some way there: keep what fits, rerole what does not; the other exit by an insert and a
    rerole at the last turn that stays."""
    cost, state, last = 0, entry, None
    for sign in signs:
        cut = CUT_OFF if sign.isupper() else 0
        if sign == "-":
            cost += DELETE
        elif (sign.lower(), state) in KEPT:
            cost, state, last = cost + cut, KEPT[sign.lower(), state], cut
        else:
            cost, state, last = cost + REROLE + cut, NEXT[state], REROLE + cut
    seeds = [float("inf")] * 4
    if state >= USER:
        seeds[state] = cost
        seeds[NEXT[state]] = cost + INSERT + (0 if last is None else REROLE + CUT_OFF)
    else:
        seeds[USER], seeds[ASSISTANT] = cost + INSERT + REROLE + CUT_OFF, cost + 2 * INSERT + REROLE + CUT_OFF
    return seeds


@lru_cache(20_000)
def cheapest_edits(signs: str, entry: int) -> dict[int, tuple[int, str]]:
    """For each state in which `signs` can end when `entry` is the state before them, the least cost and, of the ways with
    that cost, the edits that are least in ASCII.

    A sign is a turn: the role's initial if it is s, u or a, else x, in upper case if the text is truncated; or - if the
    turn must go. Depth-first over (turn, state) with a stack, edits in ASCII order, so of equal costs the least way comes
    first. A way is left when the cost so far plus the suffix bound (what each turn behind must cost at least) is above
    the incumbent of every end it can still reach, or when the node's table has a way of the same or less cost. The
    search is over when the stack is empty; what the last nodes hold then is proved best.
    """
    n = len(signs)
    bound = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        least = DELETE if signs[i] == "-" else (CUT_OFF if signs[i].isupper() else 0) + (REROLE if signs[i].lower() == "x" else 0)
        bound[i] = bound[i + 1] + min(least, DELETE)
    incumbent = _seeds(signs, entry) if n else [float("inf")] * 4
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if cost + bound[i] > max(incumbent[e] for e in EXITS[state]):
            continue
        known = table.get((i, state))
        if known is not None and known <= (cost, audit):
            continue
        table[i, state] = cost, audit
        if i == n:
            incumbent[state] = min(incumbent[state], cost)
            continue
        sign, cut = signs[i].lower(), CUT_OFF if signs[i].isupper() else 0
        if sign != "-":
            stack.append((i + 1, NEXT[state], cost + REROLE + cut, audit + "R"))
            if (sign, state) in KEPT:
                stack.append((i + 1, KEPT[sign, state], cost + cut, audit + "K"))
        stack.append((i, NEXT[state], cost + INSERT, audit + "I"))
        stack.append((i + 1, state, cost + DELETE, audit + "D"))
    return {state: table[n, state] for state in range(4) if (n, state) in table}


def _joined(ways: dict[int, tuple[int, str]], step) -> dict[int, tuple[int, str]]:
    """`ways` (state: cost and edits so far) each followed by the ways `step(state)` gives; of each end the best."""
    out: dict[int, tuple[int, str]] = {}
    for state, (cost, audit) in ways.items():
        for end, (more, edits) in step(state).items():
            found = cost + more, audit + edits
            if end not in out or found < out[end]:
                out[end] = found
    return out


def _sign(run: dict) -> Iterator[str]:
    """The signs of a run of equal turns: at most its first can stay."""
    if run["copies"]:
        initial = run["role"][:1]
        sign = initial if initial in ("s", "u", "a") else "x"
        yield "-" if run["is_blank"] or run["again"] else sign.upper() if run["is_cut"] else sign
        yield from "-" * (run["copies"] - 1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _sent(rows: Iterator[dict], schema: pa.Schema, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.get("audit") or "")
        if len(held) >= most or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_WAYS = pa.list_(pa.struct([("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
_PIECE = [("conv_id", pa.int64()), ("nameless", pa.bool_()), ("segment", pa.int32())]
_SOLVED = pa.schema([
    *_PIECE, *[(c, pa.int64()) for c in ("turns", *COUNTS, "low", "high", "values", "first_turn", "last_turn")],
    ("first", pa.string()), ("last", pa.string()), ("ways", _WAYS),
])
SOLVED = f"""{PIECE}, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, low bigint, high bigint,
    `values` bigint, first_turn bigint, last_turn bigint, first string, last string,
    ways array<struct<entry: int, exit: int, cost: bigint, audit: string>>"""


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each piece of a conversation: its counts and its best edits from each state to each."""

    def pieces() -> Iterator[dict]:
        for key, runs in groupby(_rows(batches), lambda r: (r["conv_id"], r["nameless"], r["segment"])):
            out = dict(zip(("conv_id", "nameless", "segment"), key)) | dict.fromkeys(("turns", *COUNTS, "values"), 0)
            out |= dict.fromkeys(("low", "high", "first_turn", "last_turn", "first", "last"))
            ways = {entry: {entry: (0, "")} for entry in range(4)}
            signs = ""
            for run in runs:
                if not run["copies"]:
                    continue
                initial, copies = run["role"][:1], run["copies"]
                turn = run["turn"] if run["numbered"] else None
                if not out["turns"]:
                    out["first"], out["first_turn"] = initial, turn
                elif not _legal(out["last"], initial):
                    out["illegal"] += 1
                out["illegal"] += copies - 1
                out["turns"] += copies
                if run["is_blank"]:
                    out["blank"] += copies
                else:
                    out["duplicate"] += copies - 1 + run["again"]
                    out["truncated"] += run["is_cut"] and not run["again"]
                if turn is not None:
                    out["values"] += out["last_turn"] is None or turn != out["last_turn"]
                    out["low"], out["high"] = turn if out["low"] is None else out["low"], turn
                out["last"], out["last_turn"] = initial, turn
                for sign in _sign(run):
                    signs += sign
                    if len(signs) == CHUNK:
                        ways = {e: _joined(w, lambda s, c=signs: cheapest_edits(c, s)) for e, w in ways.items()}
                        signs = ""
            if signs:
                ways = {e: _joined(w, lambda s, c=signs: cheapest_edits(c, s)) for e, w in ways.items()}
            out["ways"] = [
                {"entry": e, "exit": x, "cost": cost, "audit": audit} for e, w in ways.items() for x, (cost, audit) in w.items()
            ]
            yield out

    return _sent(pieces(), _SOLVED, 1024)


_PLANNED = pa.schema([
    *_PIECE, ("entry", pa.int32()), ("position", pa.int64()), ("gaps", pa.int64()), *[(c, pa.int64()) for c in (*COUNTS, "cost")],
    ("audit", pa.string()),
])
PLANNED = f"""{PIECE}, entry int, position bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,
    cost bigint, audit string"""


def _plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each conversation a row with segment -1 and its counts, cost and whole audit, and one for each piece with the
    state before it, the number of turns put out before it and its own edits."""

    def plans() -> Iterator[dict]:
        for key, found in groupby(_rows(batches), lambda r: (r["conv_id"], r["nameless"])):
            name = dict(zip(CONVERSATION, key))
            whole = name | {"segment": -1, "entry": None, "position": None} | dict.fromkeys(("gaps", *COUNTS), 0)
            best = {NOTHING: (0, "", ())}
            segments, low, high, values, last, last_turn = [], None, None, 0, None, None
            for piece in found:
                if not piece["turns"]:
                    continue
                segments.append(piece["segment"])
                for c in COUNTS:
                    whole[c] += piece[c]
                whole["illegal"] += last is not None and not _legal(last, piece["first"])
                low = piece["low"] if low is None else low
                high = piece["high"] if piece["high"] is not None else high
                values += piece["values"] - (last_turn is not None and piece["first_turn"] == last_turn)
                last, last_turn = piece["last"], piece["last_turn"]
                after: dict = {}
                for way in piece["ways"]:
                    if way["entry"] in best:
                        cost, audit, path = best[way["entry"]]
                        made = cost + way["cost"], audit + way["audit"], (*path, (way["entry"], len(audit)))
                        if way["exit"] not in after or made < after[way["exit"]]:
                            after[way["exit"]] = made
                best = after
            ends = [(c + INSERT * len(TRAIL[s]), a + TRAIL[s], p) for s, (c, a, p) in best.items()]
            cost, audit, path = min(ends)
            yield whole | {"gaps": 0 if low is None else high - low + 1 - values, "cost": cost, "audit": audit}
            position = 0
            for at, (entry, begin) in enumerate(path):
                edits = audit[begin : path[at + 1][1] if at + 1 < len(path) else None]
                yield name | {"segment": segments[at], "entry": entry, "position": position, "audit": edits}
                position += len(edits) - edits.count("D")

    return _sent(plans(), _PLANNED)


_EDITED = pa.schema([
    *_PIECE[:2], ("numbered", pa.bool_()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()),
    ("position", pa.int64()), ("new_role", pa.string()),
])
EDITED = "conv_id bigint, nameless boolean, numbered boolean, turn bigint, role string, digest string, position bigint, new_role string"


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that stay, with their position and role, and the inserted ones (digest null), from rows in which each
    piece's plan (`plan` true) comes before its runs."""

    def edits() -> Iterator[dict]:
        for key, rows in groupby(_rows(batches), lambda r: (r["conv_id"], r["nameless"], r["segment"])):
            name, audit, at, state, position = dict(zip(CONVERSATION, key)), "", 0, NOTHING, 0

            def inserts() -> Iterator[dict]:
                nonlocal at, state, position
                while audit[at : at + 1] == "I":
                    state = NEXT[state]
                    yield name | {"position": position, "new_role": NAMES[state]}
                    at, position = at + 1, position + 1

            for row in rows:
                if row["audit"] is not None:
                    audit, at, state, position = row["audit"], 0, row["entry"], row["position"]
                    continue
                for nth in range(row["copies"]):
                    yield from inserts()
                    edit = audit[at]
                    at += 1
                    if edit == "D":
                        continue
                    state = KEPT[row["role"][:1], state] if edit == "K" else NEXT[state]
                    role = row["role"] if edit == "K" else NAMES[state]
                    yield name | {c: row[c] for c in PLACE} | {"position": position, "new_role": role}
                    position += 1
            yield from inserts()

    return _sent(edits(), _EDITED)


def read_turns(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text and, if rows stand for several or none, copies) with keys that are never null,
    the digest of each text and its faults that show in itself. Null roles and texts are one space."""
    copies = F.col("copies") if "copies" in turns.columns else F.lit(1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    return turns.select(
        F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("nameless"),
        F.col("turn").isNotNull().alias("numbered"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.sha2(text, 256).alias("digest"), text.alias("text"),
        copies.cast("bigint").alias("copies"), (~text.rlike(f"[^{BLANK}]")).alias("is_blank"),
        (~text.rlike(rf"[.!?][{BLANK}]*\z")).alias("is_cut"),
    )


def plan_repairs(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The runs of equal turns of each conversation in order, cut into pieces, and the plan of repair (see `_plan`).

    Equal turns are counted before they move. Runs are range-sorted by conversation and place; a conversation that
    spans several ranges is as many pieces, each searched on its own from every state, in chunks of `CHUNK` turns; only
    costs and edits of pieces meet. Texts take no part.
    """
    read = read_turns(turns)
    runs = read.groupBy(*CONVERSATION, *PLACE).agg(
        F.sum("copies").alias("copies"), F.first("is_blank").alias("is_blank"), F.first("is_cut").alias("is_cut")
    )
    runs = stage(runs, "repair-runs")
    place = F.struct("numbered", "turn")
    same = [*CONVERSATION, "role", "digest"]
    first = runs.where("copies > 0").groupBy(*same).agg(F.min(place).alias("first_place"))
    marked = runs.join(first, same, "left").withColumn("again", F.coalesce(F.col("first_place") < place, F.lit(False)))
    order = [*CONVERSATION, *PLACE]
    ranged = marked.drop("first_place").repartitionByRange(*order).withColumn("segment", F.spark_partition_id())
    ranged = stage(ranged.select(*CONVERSATION, "segment", *PLACE, "copies", "is_blank", "is_cut", "again"), "repair-ranges")
    piece = [*CONVERSATION, "segment"]
    solved = ranged.repartition(*piece).sortWithinPartitions(*piece, *PLACE).mapInArrow(_solve, SOLVED)
    planned = solved.repartition(*CONVERSATION).sortWithinPartitions(*piece).mapInArrow(_plan, PLANNED)
    return ranged, stage(planned, "repair-plan")


def repair_report(plan: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit: one row for each conversation."""
    named = F.when(~F.col("nameless"), F.col("conv_id")).alias("conv_id")
    return plan.where("segment = -1").select(named, "gaps", *COUNTS, "cost", "audit")


def repaired_turns(turns: DataFrame, ranged: DataFrame, plan: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, nameless, position (from 0), role, text."""
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("entry", "int"), ("position", "bigint"), ("audit", "string"))]
    piece = [*CONVERSATION, "segment"]
    plans = plan.where("segment >= 0").select(*piece, "entry", "position", "audit")
    both = ranged.select(*piece, *PLACE, "copies", *empty).unionByName(plans, allowMissingColumns=True)
    order = [*piece, F.col("audit").asc_nulls_last(), *PLACE]
    edits = stage(both.repartition(*piece).sortWithinPartitions(*order).mapInArrow(_edit, EDITED), "repair-edits")
    stay = edits.where("digest IS NOT NULL")
    texts = read_turns(turns).where("copies > 0").groupBy(*CONVERSATION, *PLACE).agg(F.first("text").alias("text"))
    kept = stay.join(texts, [*CONVERSATION, *PLACE])
    added = edits.where("digest IS NULL").withColumn("text", F.lit(""))
    return kept.select(added.columns).unionByName(added).select(*CONVERSATION, "position", F.col("new_role").alias("role"), "text")


def conversation_digests(repaired: DataFrame) -> DataFrame:
    """conv_id, nameless and the SHA-256 of each conversation's `role:text` lines. A digest needs its lines one after
    another, so each conversation is one stream through one task, of which a line is held at a time."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for key, lines in groupby(_rows(batches), lambda r: (r["conv_id"], r["nameless"])):
                whole = hashlib.sha256()
                for at, line in enumerate(lines):
                    whole.update(("\n" * (at > 0) + line["role"] + ":").encode())
                    whole.update(line["text"].encode())
                yield dict(zip(CONVERSATION, key)) | {"repaired_sha256": whole.hexdigest()}

        return _sent(rows(), pa.schema([*_PIECE[:2], ("repaired_sha256", pa.string())]))

    ordered = repaired.repartition(*CONVERSATION).sortWithinPartitions(*CONVERSATION, "position")
    return ordered.mapInArrow(digest, "conv_id bigint, nameless boolean, repaired_sha256 string")


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The cheapest repair of each conversation of `turns` (conv_id, turn, role, text; copies if given, see `read_turns`).

    Turns are taken by turn number (none first), then role, then digest of the text. Edits: keep, delete (3; blank turns
    and repeated ones must go), insert an empty turn (2), rerole (2), and 1 for each truncated turn that stays; the result
    is nothing, or user and assistant in turn after at most one system turn. Of equal costs the audit that is least in
    ASCII. Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    A null conv_id is a conversation of its own. Conversations of which no row is left (copies 0) get zeros, an empty
    audit and the digest of nothing. Other columns are not looked at. An empty table gives no rows.
    """
    ranged, plan = plan_repairs(turns)
    digests = conversation_digests(repaired_turns(turns, ranged, plan))
    whole = plan.where("segment = -1").join(digests, CONVERSATION, "left")
    named = F.when(~F.col("nameless"), F.col("conv_id")).alias("conv_id")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return whole.select(named, "gaps", *COUNTS, "cost", "audit", F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def damage(conversations: DataFrame) -> DataFrame:
    """`conversations` with faults set by crc32 of `conv_id:turn` modulo 20 (nulls: one space): 0 drops the row (copies 0),
    1 empties its text, 2 removes its closing marks, 3 repeats it, 4 makes its role user."""

    def plain(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat_ws(":", plain("conv_id"), plain("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain("text"), "[.!?]", "")).otherwise(plain("text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(plain("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )
