"""Finite state machines over histories of any length, without a history in one task.

What a run of events does is a function on the machine's few states, and such functions compose. Rows are dealt
by ranges of (key, order), so a long history spans tasks; each row gets the function of the rows of its task that come
before it, a character for each state. Histories that span tasks, at most one for each border between tasks, are
told by the functions of their pieces in which state each piece starts; all others start at the beginning.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.storage import kept

POSITION = "__pos"


def states_before(rows: DataFrame, key: str, order: Sequence[str], symbol: Column, moves: Mapping[tuple[str, str], str], initial: str) -> DataFrame:
    """``rows`` with ``before``, the state in which each finds its key's machine, ``__symbol`` and ``__pos``, which orders rows.

    ``moves`` leads from (state, symbol) to a state; any other symbol, a null one too, changes nothing. Ties in
    ``order`` are broken by the symbol. Rows of a null key are one history.
    """
    states = sorted({initial, *(s for s, _ in moves), *moves.values()}, key=lambda s: (s != initial, s))
    number = {s: k for k, s in enumerate(states)}
    letter = [chr(48 + k) for k in range(len(states))]
    table = {x: "".join(letter[number[moves.get((s, x), s)]] for s in states) for _, x in moves}
    same = "".join(letter)
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [key, *order, "__symbol"]
    marked = rows.withColumn("__symbol", symbol)
    names = [key, POSITION, "__symbol"]
    dealt = kept(marked.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn(POSITION, F.monotonically_increasing_id()))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, part, done = fold, -1, same
        known: dict[tuple[str, str], str] = {}
        for batch in batches:
            before, after = [], []
            for k, p, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k != who or p >> 33 != part:
                    who, part, done = k, p >> 33, same
                before.append(done)
                if x in table:
                    then = known.get((done, x))
                    if then is None:
                        own = table[x]
                        then = known[done, x] = "".join(own[ord(c) - 48] for c in done)
                    done = then
                after.append(done)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(before, pa.string()), pa.array(after, pa.string())], [key, POSITION, "__before", "__after"])

    kind = rows.schema[key].dataType.simpleString()
    part = F.shiftright(POSITION, 33)
    # Dealt by what a written row says of its task, in its order.
    ordered = dealt.select(*names).withColumn("__part", part).repartition(parts, "__part").sortWithinPartitions(POSITION).select(*names)
    functions = kept(ordered.mapInArrow(fold, f"`{key}` {kind}, {POSITION} long, __before string, __after string"))
    pieces = functions.groupBy(key, part.alias("__part")).agg(F.max_by("__after", POSITION).alias("__f"))
    spanning = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__part", "__f"))).alias("__p")).where(F.size("__p") > 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    step = lambda s, p: F.struct((F.ascii(F.substr(p["__f"], s["at"] + 1, F.lit(1))) - 48).alias("at"), F.array_append(s["starts"], s["at"]).alias("starts"))
    starts = F.aggregate("__p", start, step, lambda s: s["starts"])
    begun = spanning.select(F.col(key).alias("__k"), F.explode(F.arrays_zip(F.col("__p.__part").alias("part"), starts.alias("start"))).alias("x")).select("__k", F.col("x.part").alias("__q"), F.col("x.start").alias("__start"))
    # No more rows than twice the number of tasks.
    told = functions.join(F.broadcast(begun), F.col(key).eqNullSafe(F.col("__k")) & (part == F.col("__q")), "left")
    at = F.ascii(F.substr("__before", F.coalesce("__start", F.lit(0)) + 1, F.lit(1))) - 47
    before = F.element_at(F.array(*map(F.lit, states)), at)
    return dealt.join(told.select(POSITION, before.alias("before")), POSITION)
