"""Chat formatting by perspective rotation.

For every participant of a conversation (every role but the system's) the dialogue is rendered with that
speaker as assistant, all others as named users, system turns as system; the mask spans are the character
ranges of the assistant's own words and end marks, on which a model is to be trained.

Turns stand in the order of turn (a null one last), role and text.  A conversation is cut into parts of
consecutive rows, so no task holds an unbounded one; the parts of a rendering, in order, are the rendering.
A row belongs to part ``rows before // MAX_TURNS + characters before // MAX_CHARS``, so a conversation of
fewer rows and characters is one part, which one shuffle puts together.  The rows of the others are sorted
over all tasks and counted in two levels, within the tasks and over the tasks.

Edge cases: a null role is the speaker ``unknown``; a null text is empty; a null turn comes last; repeated rows stay;
a text longer than ``MAX_CHARS`` stays whole; a null conv_id is a conversation of its own;
a conversation of system turns only has no participant and gives no row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _common

SYSTEM = "system"
MAX_TURNS, MAX_CHARS = 512, 1_000_000
#: Long conversations, and their speakers, of which a broadcast is made; beyond that parts are dealt over so many tasks.
FEW, SALTS = 100_000, 64
BEGIN, BREAK, END = "<|", "|>\n", "\n<|end|>\n"


def render(turns: list[tuple[str, str]], speaker: str) -> tuple[str, list[tuple[int, int]]]:
    """The text, and the spans on which the speaker is trained."""
    out, spans, at = [], [], 0
    for role, text in turns:
        name = "assistant" if role == speaker else SYSTEM if role == SYSTEM else f"user name={role}"
        head = f"{BEGIN}{name}{BREAK}"
        piece = f"{head}{text}{END}"
        if role == speaker:
            spans.append((at + len(head), at + len(piece)))
        out.append(piece)
        at += len(piece)
    return "".join(out), spans


def _parts(rows: DataFrame) -> DataFrame:
    """(conv_id, part, turns) of long conversations."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    names = [*rows.columns, "slot", "n", "c"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows and characters before each row of a sorted task, within its conversation."""
        slot, conv, n, c = TaskContext.get().partitionId(), None, 0, 0
        for batch in _common.slices(batches):
            before = []
            for of, text in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if (of,) != conv:
                    conv, n, c = (of,), 0, 0
                before.append((n, c))
                n, c = n + 1, c + len(text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([slot] * len(before), pa.int64()), *(pa.array(x, pa.int64()) for x in zip(*before))], names)

    order = ["conv_id", F.col("turn").asc_nulls_last(), "role", "text"]
    # equal rows are told apart, so that a range of them can be cut
    sorted_ = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    turn = rows.schema["turn"].dataType.simpleString()
    counted = _common.written(sorted_.mapInArrow(count, f"conv_id {kind}, turn {turn}, role string, text string, slot long, n long, c long"), "turns")
    sums = counted.groupBy("conv_id", "slot").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    before = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    sums = sums.select(F.col("conv_id").alias("of"), F.col("slot").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("chars"))
    part = F.floor((F.col("rows") + F.col("n")) / MAX_TURNS) + F.floor((F.col("chars") + F.col("c")) / MAX_CHARS)
    placed = counted.join(sums, (F.col("slot") == F.col("at")) & F.col("conv_id").eqNullSafe(F.col("of")))
    return placed.groupBy("conv_id", part.alias("part")).agg(_listed())


def _listed():
    return F.sort_array(F.collect_list(F.struct(F.col("turn").isNull().alias("late"), "turn", "role", "text"))).alias("turns")


def _spread(parts: DataFrame, speakers: DataFrame) -> DataFrame:
    """(conv_id, part, speakers, turns): every part once for each speaker of its conversation.  A conversation
    of many parts is dealt over tasks where the speakers are too many for a broadcast."""
    speakers = _common.written(speakers.select(F.col("conv_id").alias("of"), F.array("role").alias("speakers")).distinct(), "speakers")
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    if speakers.limit(FEW + 1).count() <= FEW:
        found = parts.join(F.broadcast(speakers), same)
    else:
        dealt = speakers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = parts.join(dealt, same & (F.pmod("part", F.lit(SALTS)) == F.col("salt")))
    return found.select("conv_id", "part", "speakers", "turns")


def rotate(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, part, n_turns, text, mask_spans, n_masked) for every participant and part;
    ``mask_spans`` is written as begin-end pairs joined by commas."""
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c"))
    long = _common.written(sizes.where((F.col("n") > MAX_TURNS) | (F.col("c") >= MAX_CHARS)).select(F.col("conv_id").alias("of")), "long")
    some = long.limit(FEW + 1).count()
    kind = turns.schema["conv_id"].dataType.simpleString()
    same = F.col("conv_id").eqNullSafe(F.col("of"))
    told = F.broadcast(long) if some <= FEW else long
    short = rows.join(told, same, "left_anti") if some else rows
    whole = short.groupBy("conv_id").agg(_listed()).select("conv_id", F.lit(0).cast("long").alias("part"), F.lit(None).cast("array<string>").alias("speakers"), "turns")
    if some:
        rest = rows.join(told, same, "left_semi")
        whole = whole.unionByName(_spread(_parts(rest), rest.where(F.col("role") != SYSTEM)))
    names = ["conv_id", "perspective", "part", "n_turns", "text", "mask_spans", "n_masked"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                said = [(t["role"], t["text"]) for t in one.column(3)[0].as_py()]
                speakers = one.column(2)[0].as_py()
                for speaker in sorted({role for role, _ in said} - {SYSTEM}) if speakers is None else speakers:
                    text, spans = render(said, speaker)
                    yield pa.RecordBatch.from_arrays(
                        [one.column(0), pa.array([speaker]), one.column(1), pa.array([len(said)], pa.int64()), pa.array([text]), pa.array([",".join(f"{a}-{b}" for a, b in spans)]), pa.array([sum(b - a for a, b in spans)], pa.int64())],
                        names,
                    )

    shape = f"conv_id {kind}, perspective string, part long, n_turns long, text string, mask_spans string, n_masked long"
    return whole.select("conv_id", "part", "speakers", F.expr("transform(turns, t -> struct(t.role, t.text))").alias("turns")).mapInArrow(run, shape)
