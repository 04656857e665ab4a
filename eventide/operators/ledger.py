"""Hash-linked logs: building, verification, Merkle roots and proofs.

Many logs are handled at once, each known by ``job_id``.  Verification is parallel, as every
link names the hash that is stored before it; building a chain follows its order, one log after the other in a task.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import length_prefixed
from ..sources.storage import stored
from . import scans
from .streams import folded

GENESIS = "0" * 64


def entry_hash(seq: Column, prev: Column, statement: Column) -> Column:
    return F.sha2(length_prefixed(seq, prev, statement), 256)


def linked(statements: DataFrame, start: Callable[[dict], tuple[int, str]], number: Callable[[int, dict], int]) -> DataFrame:
    """Statements linked in order of ``seq``: a log streams by, and only its head is held."""

    def fold() -> Callable[[dict], list[tuple]]:
        head: tuple[int, str] | None = None

        def step(row: dict) -> list[tuple]:
            nonlocal head
            last, prev = head or start(row)
            seq = number(last, row)
            parts = (str(seq), prev, row["statement_hash"])
            entry = hashlib.sha256("|".join(f"{len(p)}:{p}" for p in parts if p is not None).encode()).hexdigest()
            head = seq, entry
            return [(seq, row["statement_hash"], prev, entry)]

        return step

    return folded(statements, ["job_id"], ["seq", "statement_hash"], fold, "seq int, statement_hash string, prev_hash string, entry_hash string")


def chained(statements: DataFrame) -> DataFrame:
    """(job_id, seq, statement_hash, prev_hash, entry_hash): statements linked in order of ``seq``."""
    return linked(statements.select("job_id", "seq", "statement_hash"), lambda row: (0, GENESIS), lambda last, row: row["seq"])


def appended(log: DataFrame, statements: DataFrame) -> DataFrame:
    """New links for statements after the head of each log; an unknown log begins with the genesis hash."""
    head = log.groupBy("job_id").agg(F.max("seq").alias("last"), F.max_by("entry_hash", "seq").alias("head"))
    rows = statements.select("job_id", "seq", "statement_hash").join(head, "job_id", "left")
    return linked(rows, lambda row: (row["last"] or 0, row["head"] or GENESIS), lambda last, row: last + 1)


def problems(log: DataFrame, statements: DataFrame | None = None) -> DataFrame:
    """(job_id, seq, problem): what is wrong with each entry; goes on after a failure.

    sequence_gap, broken_link, entry_hash_mismatch and, with the statements' true
    hashes, statement_altered.
    """
    w = Window.partitionBy("job_id").orderBy("seq")
    rows = log.withColumns({"want_seq": F.row_number().over(w), "want_prev": F.lag("entry_hash", 1, GENESIS).over(w)})
    if statements is not None:
        rows = rows.join(statements.select("job_id", "seq", F.col("statement_hash").alias("true_hash")), ["job_id", "seq"], "left")
    else:
        rows = rows.withColumn("true_hash", F.lit(None).cast("string"))
    checks = {
        "sequence_gap": F.col("seq") != F.col("want_seq"),
        "broken_link": F.col("prev_hash") != F.col("want_prev"),
        "statement_altered": F.coalesce(F.col("true_hash") != F.col("statement_hash"), F.lit(False)),
        "entry_hash_mismatch": F.col("entry_hash") != entry_hash(F.col("seq"), F.col("prev_hash"), F.col("statement_hash")),
    }
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    return rows.select("job_id", "seq", F.explode(found).alias("problem"))


def chain_problems(entry: dict, want_seq: int, want_prev: str) -> list[str]:
    """What is wrong with one entry after the one before it; the plain twin of ``problems``, for streams."""
    parts = (str(entry["seq"]), entry["prev_hash"], entry["statement_hash"])
    true = hashlib.sha256("|".join(f"{len(p)}:{p}" for p in parts if p is not None).encode()).hexdigest()
    checks = {"sequence_gap": entry["seq"] != want_seq, "broken_link": entry["prev_hash"] != want_prev, "entry_hash_mismatch": entry["entry_hash"] != true}
    return [k for k, wrong in checks.items() if wrong]


def leaf(data: Column) -> Column:
    return F.sha2(F.concat(F.lit("00"), data), 256)


def node(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit("01"), left, right), 256)


#: A subtree has so many levels above its leaves, and is folded within a row.
SUBTREE = 10
STEPS = "array<struct<level:int,side:string,sibling:string>>"


def numbered_leaves(leaves: DataFrame, order: str = "seq", data: str = "entry_hash") -> DataFrame:
    """(job_id, i, hash): the leaves of each log in order, from 0; a long log is numbered in stretches."""
    s = scans.scanned(scans.series(leaves.select("job_id", F.col(order).alias("_order"), F.col(data).alias("_data")), ["job_id"], ["_order", "_data"]), i=scans.number())
    return s.frame().select("job_id", (F.col("i") - 1).alias("i"), leaf(F.col("_data")).alias("hash"))


def subtrees(nodes: DataFrame) -> DataFrame:
    """(job_id, block, levels): nodes folded 2^``SUBTREE`` at a time; ``levels`` goes from them to their one root, an odd last node being promoted."""
    at = F.struct("i", "hash")
    rows = nodes.groupBy("job_id", F.floor(F.col("i") / (1 << SUBTREE)).alias("block")).agg(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["hash"]).alias("_nodes"))

    def up(level: Column) -> Column:
        pair = lambda j: F.when(2 * j + 1 < F.size(level), node(F.get(level, 2 * j), F.get(level, 2 * j + 1))).otherwise(F.get(level, 2 * j))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int")), pair)

    levels = F.aggregate(F.sequence(F.lit(1), F.lit(SUBTREE)), F.array("_nodes"), lambda known, _: F.concat(known, F.array(up(F.element_at(known, -1)))))
    return rows.select("job_id", "block", levels.alias("levels"))


def top(levels: Column) -> Column:
    return F.get(F.element_at(levels, -1), F.lit(0))


def merkle_towers(leaves: DataFrame, order: str = "seq", data: str = "entry_hash") -> list[DataFrame]:
    """Storeys of subtrees, from the leaves up, each stored: the nodes of a storey are the roots of the one below.

    A storey is one aggregation, and a thousandth as large as the one below; the last has one subtree a log.
    """
    nodes = numbered_leaves(leaves, order, data)
    towers = []
    while True:
        towers.append(stored(subtrees(nodes), "merkle"))
        if towers[-1].where("block > 0").isEmpty():
            return towers
        nodes = towers[-1].select("job_id", F.col("block").alias("i"), top(F.col("levels")).alias("hash"))


def merkle_roots(leaves: DataFrame, order: str = "seq", data: str = "entry_hash") -> DataFrame:
    """(job_id, root) of each log."""
    return merkle_towers(leaves, order, data)[-1].select("job_id", top(F.col("levels")).alias("root"))


def siblings(levels: Column, pos: Column, storey: int) -> Column:
    """The steps from a subtree's ``pos``-th node to its root; promoted levels have no sibling."""

    def step(k: Column) -> Column:
        at = F.floor(pos / F.pow(F.lit(2.0), k)).cast("int")
        left = at % 2 == 0
        return F.struct((k + storey * SUBTREE).cast("int").alias("level"), F.when(left, "right").otherwise("left").alias("side"), F.get(F.get(levels, k), F.when(left, at + 1).otherwise(at - 1)).alias("sibling"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.lit(SUBTREE - 1)), step), lambda s: s["sibling"].isNotNull())


def merkle_proofs(leaves: DataFrame, order: str = "seq", data: str = "entry_hash") -> DataFrame:
    """(job_id, i, level, side, sibling): what proves each leaf; promoted levels have no sibling.

    A leaf's steps lie in its subtree; those above are its subtree's, and are joined once a subtree.
    """
    towers = merkle_towers(leaves, order, data)
    blocks = towers[0].withColumn("_above", F.array().cast(STEPS))
    for k, tower in enumerate(towers[1:]):
        nodes = tower.select("job_id", "block", "levels", F.posexplode(F.get("levels", F.lit(0))).alias("_pos", "_hash"))
        nodes = nodes.select("job_id", (F.col("block") * (1 << SUBTREE) + F.col("_pos")).alias("_node"), siblings(F.col("levels"), F.col("_pos"), k + 1).alias("_steps"))
        blocks = blocks.withColumn("_node", F.floor(F.col("block") / (1 << SUBTREE * k))).join(nodes, ["job_id", "_node"]).withColumn("_above", F.concat("_above", F.col("_steps").cast(STEPS))).drop("_node", "_steps")
    each = blocks.select("job_id", "block", "levels", "_above", F.posexplode(F.get("levels", F.lit(0))).alias("_pos", "_hash"))
    steps = F.concat(siblings(F.col("levels"), F.col("_pos"), 0).cast(STEPS), F.col("_above"))
    return each.select("job_id", (F.col("block") * (1 << SUBTREE) + F.col("_pos")).alias("i"), F.inline(steps))


def proofs_hold(leaves: DataFrame, proofs: DataFrame, roots: DataFrame, order: str = "seq", data: str = "entry_hash") -> DataFrame:
    """(job_id, i, ok): each leaf folded up its proof against the root."""
    first = numbered_leaves(leaves, order, data)
    steps = proofs.groupBy("job_id", "i").agg(F.array_sort(F.collect_list(F.struct("level", "side", "sibling"))).alias("steps"))
    fold = F.aggregate(F.coalesce("steps", F.array().cast("array<struct<level:int,side:string,sibling:string>>")), F.col("hash"), lambda h, s: F.when(s["side"] == "right", node(h, s["sibling"])).otherwise(node(s["sibling"], h)))
    return first.join(steps, ["job_id", "i"], "left").join(roots, "job_id").select("job_id", "i", (fold == F.col("root")).alias("ok"))


#: The largest integer that doubles tell from its neighbours.
MOST_INTEGER = 2**53 - 1
#: The short escapes of JSON text.
ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def canonical(value: object) -> str:
    """JSON as a browser writes it, without white space and with keys in order of their UTF-16 units.

    Numbers are doubles: whole ones have no point, -0 is 0, exponents begin at 1e21 and below 1e-6.
    Raises ValueError for what has no exact form: integers past 2**53 - 1, NaN, infinities, other types.
    """
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    if isinstance(value, str):
        return _text(value)
    if isinstance(value, int | float):
        return _number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("keys must be text")
        order = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{_text(k)}:{canonical(value[k])}" for k in order) + "}"
    raise ValueError(f"{type(value).__name__} has no canonical form")


def _text(text: str) -> str:
    plain = (ESCAPES.get(c) or (f"\\u{ord(c):04x}" if c < " " or "\ud800" <= c <= "\udfff" else c) for c in text)
    return '"' + "".join(plain) + '"'


def _number(value: float) -> str:
    try:
        x = float(value)
    except OverflowError:
        raise ValueError("number is not finite") from None
    if not math.isfinite(x):
        raise ValueError("number is not finite")
    if x.is_integer():
        if abs(x) > MOST_INTEGER:
            raise ValueError("integer out of the safe range")
        return str(int(x))
    # repr has the shortest digits that give the double back; only its notation differs
    _, digits, exponent = Decimal(repr(x)).as_tuple()
    sign, figures = "-" if x < 0 else "", "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent  # the place of the decimal point, from the first digit
    if point > 0:
        return f"{sign}{figures[:point]}.{figures[point:]}"
    if point > -6:
        return f"{sign}0.{'0' * -point}{figures}"
    rest = f".{figures[1:]}" if len(figures) > 1 else ""
    return f"{sign}{figures[0]}{rest}e{point - 1}"


def canonical_json(col: Column) -> Column:
    """The canonical form of JSON text; null for text that is no JSON or has none."""

    def refused(name: str) -> None:
        raise ValueError(name)

    def one(text: str | None) -> str | None:
        try:
            return canonical(json.loads(text, parse_constant=refused)).encode().decode()
        except (TypeError, ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(col)


#: The fields of a statement, as its hash covers them.
STATEMENT = {"kind": "kind", "subject": "subject", "jobId": "job_id", "actorId": "actor_id", "timestamp": "timestamp", "payloadHash": "payload_hash"}


def statement_hash(payload: str = "payload") -> Column:
    """SHA-256 of a statement's canonical form; ``payload`` is JSON text, and null if it has no canonical form."""
    fields = F.to_json(F.struct(*[F.col(c).alias(k) for k, c in STATEMENT.items()]), {"ignoreNullFields": "false"})
    whole = F.concat(F.regexp_replace(fields, "\\}$", ""), F.lit(',"payload":'), F.col(payload), F.lit("}"))
    return F.sha2(canonical_json(whole), 256)


def batches(log: DataFrame) -> DataFrame:
    """(job_id, root, from_seq, to_seq, entries): the Merkle batch of each log."""
    span = log.groupBy("job_id").agg(F.min("seq").alias("from_seq"), F.max("seq").alias("to_seq"), F.count(F.lit(1)).alias("entries"))
    return merkle_roots(log).join(span, "job_id")


def split_chains(main: DataFrame, local: DataFrame, found: DataFrame) -> DataFrame:
    """(job_id, orphaned, split, ok): a log is split if entries were left in a local file beside the main one.

    ``ok`` needs a log without ``problems`` (``found``) and without a split.
    """
    known = main.select("job_id", "entry_hash").distinct()
    left = local.groupBy("job_id").agg(F.count(F.lit(1)).alias("orphaned"))
    bad = found.select("job_id").distinct().withColumn("bad", F.lit(True))
    jobs = known.select("job_id").unionByName(local.select("job_id")).distinct()
    j = jobs.join(left, "job_id", "left").join(bad, "job_id", "left").fillna({"orphaned": 0})
    return j.select("job_id", "orphaned", (F.col("orphaned") > 0).alias("split"), (F.col("bad").isNull() & (F.col("orphaned") == 0)).alias("ok"))


def orphaned(main: DataFrame, local: DataFrame) -> DataFrame:
    """Local entries that the main log does not hold."""
    return local.join(main.select("job_id", "entry_hash"), ["job_id", "entry_hash"], "left_anti")


def anchored(log: DataFrame, batch: DataFrame, reference: Column) -> DataFrame:
    """Entries with the root of the batch that takes them in, and where that was published (``reference``, of a batch's columns).

    Publishing itself is the caller's: it hands in what the service returned, or null where there is none.
    """
    taken = batch.select("job_id", F.col("root").alias("anchor_root"), "from_seq", "to_seq", reference.alias("anchor_ref"))
    j = log.drop("anchor_root", "anchor_ref").join(taken, "job_id", "left")
    inside = F.col("seq").between(F.col("from_seq"), F.col("to_seq"))
    return j.withColumns({c: F.when(inside, F.col(c)) for c in ("anchor_root", "anchor_ref")}).drop("from_seq", "to_seq")


#: The names of an entry's fields outside the database, by column.
ENTRY = {"seq": "seq", "kind": "kind", "subject": "subject", "jobId": "job_id", "actorId": "actor_id", "timestamp": "timestamp", "payloadHash": "payload_hash"}


def entry_documents(log: DataFrame) -> DataFrame:
    """(job_id, seq, entry): rows as JSON documents; the timestamp stays as it was signed."""
    return log.select("job_id", "seq", F.to_json(F.struct(*[F.col(c).alias(k) for k, c in ENTRY.items()]), {"ignoreNullFields": "false"}).alias("entry"))


def unanchored(log: DataFrame) -> DataFrame:
    """Entries that no batch has taken in yet."""
    return log.where(F.col("anchor_root").isNull())


def violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """(job_id, seq, problem): entries that were ``deleted`` or ``altered`` between two states of append-only logs."""
    kept = after.select("job_id", "seq", F.col("entry_hash").alias("now"))
    j = before.select("job_id", "seq", "entry_hash").join(kept, ["job_id", "seq"], "left")
    problem = F.when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("entry_hash"), "altered")
    return j.select("job_id", "seq", problem.alias("problem")).where(F.col("problem").isNotNull())


def artifact_hashes(log: DataFrame, kind: str = "artifact_derived") -> DataFrame:
    """(job_id, subject, payload_hash): of each artifact's entries the last counts."""
    return log.where(F.col("kind") == kind).groupBy("job_id", "subject").agg(F.max_by("payload_hash", "seq").alias("payload_hash"))


#: The kinds of entries that a log takes, and the shape of a digest.
KINDS = ("video_uploaded", "artifact_derived", "verdict_recorded", "anchor_published", "report_generated")
DIGEST = "^[0-9a-f]{64}$"


def constraint_violations(log: DataFrame) -> DataFrame:
    """Entries with a problem for each rule that they break: kind, payload_hash, seq or subject."""
    checks = {"kind": ~F.col("kind").isin(*KINDS), "payload_hash": ~F.col("payload_hash").rlike(DIGEST), "seq": F.col("seq") < 1, "subject": F.coalesce("subject", F.lit("")) == ""}
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in checks.items()]))
    return log.select("*", F.explode(found).alias("problem"))


#: What each message makes of a job's state; other messages are refused.
TRANSITIONS = {(None, "queue"): "queued", ("queued", "start"): "processing", ("queued", "cancel"): "cancelled", ("processing", "finish"): "done", ("processing", "fail"): "error", ("done", "queue"): "queued", ("error", "queue"): "queued", ("cancelled", "queue"): "queued"}


def job_states(messages: DataFrame) -> DataFrame:
    """(job_id, state, accepted, refused) after all messages (job_id, ts, n, message) in order of time and number."""

    def fold() -> Callable[[dict], list[tuple]]:
        state: str | None = None

        def step(row: dict) -> list[tuple]:
            nonlocal state
            after = TRANSITIONS.get((state, row["message"]))
            state = after or state
            return [(row["n"], state, after is not None)]

        return step

    kind = messages.schema["n"].dataType.simpleString()
    steps = folded(messages.select("job_id", "ts", "n", "message"), ["job_id"], ["ts", "n"], fold, f"n {kind}, state string, taken boolean")
    order = F.struct("ts", "n")
    last = steps.join(messages.select("job_id", "n", "ts"), ["job_id", "n"])
    return last.groupBy("job_id").agg(F.coalesce(F.max_by("state", order), F.lit("")).alias("state"), F.count_if("taken").alias("accepted"), F.count_if(~F.col("taken")).alias("refused"))
