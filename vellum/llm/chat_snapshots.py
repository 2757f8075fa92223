"""Chat formatting with cumulative-snapshot collapse, in DataFrame functions only.

A conversation is logged again and again as it grows. Each turn gets a rolling hash of all turns up to
it; a conversation whose last hash is found at the same length inside a longer one is a snapshot of it
and goes, by an anti-join. Of equal conversations the smallest conv_id stays. The conversations left
are rendered turn by turn.

Hashes roll as running XORs of the hashes of (ordinal, role, text), under two seeds, so a window pass
in turn order suffices. Prefix hashes are made distinct, with partial aggregation, before the join: a
first turn that a third of all conversations share is one row.

Defined cases: turns are ordered by (turn, role, text), nulls first; repeated rows of a conversation
count once. A null role or text is hashed as such and rendered as empty. Rows with a null conv_id
form one conversation. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize

TEMPLATE = "<|%s|>\n%s\n<|end|>\n"


def maximal(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(turns with ordinal and prefix hashes, the conversations that stay)."""
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("n", F.row_number().over(order))
    body = [F.col("n"), F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text")]
    rows = materialize(rows.withColumns({"p": F.bit_xor(F.xxhash64(F.lit(1), *body)).over(so_far), "q": F.bit_xor(F.xxhash64(F.lit(2), *body)).over(so_far)}), "turns")
    whole = rows.groupBy("conv_id").agg(F.max(F.struct("n", "p", "q")).alias("last")).select("conv_id", "last.*")
    first = materialize(whole.groupBy("n", "p", "q").agg(F.min("conv_id").alias("conv_id")), "conversations")
    ends = first.select(F.col("conv_id").alias("c"), F.col("n").alias("size"))
    inner = rows.join(ends, rows["conv_id"].eqNullSafe(ends["c"])).where("n < size").select("n", "p", "q").distinct()
    return rows, first.join(inner, ["n", "p", "q"], "left_anti").select("conv_id", F.col("n").alias("n_turns"))


def render(turns: DataFrame, template: str = TEMPLATE, **columns: str) -> DataFrame:
    """(conv_id, n_turns, rendered) of the conversations that stay."""
    rows, stay = maximal(turns, **columns)
    stay = stay.withColumnRenamed("conv_id", "c")
    blank = lambda c: F.coalesce(c, F.lit(""))
    pieces = rows.join(stay, rows["conv_id"].eqNullSafe(stay["c"])).select("conv_id", "n_turns", "n", F.format_string(template, blank("role"), blank("text")).alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy("conv_id").agg(F.first("n_turns").cast("long").alias("n_turns"), joined.alias("rendered"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n, role, text
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
), c AS (
  SELECT conv_id, count(*) AS n, list({'r': role, 't': text} ORDER BY n) AS body,
    string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '' ORDER BY n) AS rendered
  FROM t GROUP BY conv_id
), one AS (
  SELECT min(conv_id) AS conv_id, n, body, any_value(rendered) AS rendered FROM c GROUP BY n, body
)
SELECT conv_id, n AS n_turns, rendered FROM one a
WHERE NOT EXISTS (SELECT 1 FROM one b WHERE b.n > a.n AND b.body[1] IS NOT DISTINCT FROM a.body[1] AND b.body[1:a.n] IS NOT DISTINCT FROM a.body)
"""
