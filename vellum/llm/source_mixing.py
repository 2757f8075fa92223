"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target of tokens: the whole budget shared by weight, no source above ``most_epochs``
times its size, the excess shared again (``targets``). A source's documents are taken in complete epochs
first. What is left of its target is a fraction of an epoch: documents draw exponential keys, -ln(u) over
their quality weight, and are taken in the order of their keys until the sum of their sizes meets what is
left; the last one is cut, so that a source misses its target by less than a word.

u is a hash of the document's id and text, so a rerun draws alike however the rows are dealt.

No source is sorted whole. Keys fall into cells of equal probability under the exponential law of weight
one, some thousand documents each; sums of cells tell in which cell a source's budget ends, earlier cells
are taken and later ones left without a sort, and only the documents of that cell are put in order.
Sources are ranked and given targets over a table of one small row each.

Defined cases: a null or empty text has size 0 and is never taken for words; a null source is a source of
its own, last in order; a row without an id draws by its text; a repeated row (same id, source and text)
is a document of its own with a key of its own; sources without words have target 0. A weight that is
null counts as ``unknown``, one that is NaN or less than ``least_weight`` as that. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize, shuffle_parts

#: A word is a run of characters other than these.
WORD = r"[^\x20\x09-\x0D]+"
CELL_ROWS = 4000
COPIES_AT_ONCE = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def label_weights(labels: DataFrame, good: float = 1.0, bad: float = 0.25) -> DataFrame:
    """(doc_id, weight) by labelled quality; labels of one id that disagree count as bad."""
    judged = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return judged.select("doc_id", F.when(F.col("quality") > 0, good).otherwise(bad).alias("weight"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) over (source, source_size): ``weights`` in the order of names, repeated; null last.

    A source is full where its cap is at most its share. In the order of cap to weight the full ones come
    first, so running sums tell them: whole numbers throughout, one division at the end.
    """
    cycle = F.element_at(F.array(*(F.lit(x) for x in weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("place", F.expr("row_number() OVER (ORDER BY source ASC NULLS LAST)")).withColumn("w", cycle.cast("decimal(38,0)"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * most_epochs).cast("decimal(38,0)"))
    before = "OVER (ORDER BY CAST(cap AS double) / CAST(w AS double), place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sums = ranked.selectExpr("source", "source_size", "w", "cap", f"coalesce(sum(cap) {before}, 0) AS full", f"sum(w) OVER () - coalesce(sum(w) {before}, 0) AS open", "sum(source_size) OVER () AS whole")
    # What is to be shared is percent / 100 * whole; both sides times 100.
    left = f"(CAST(whole AS decimal(38,0)) * {percent} - full * 100)"
    shares = sums.withColumn("is_full", F.expr(f"cap * 100 * open <= w * {left}"))
    first_open = F.expr(f"min_by(named_struct('left', CAST({left} AS double), 'open', CAST(open * 100 AS double)), CASE WHEN NOT is_full THEN full END) OVER ()")
    shares = shares.withColumn("level", first_open)
    return shares.select("source", "source_size", F.when(F.col("is_full"), F.col("cap").cast("double")).otherwise(F.col("w").cast("double") * F.col("level.left") / F.col("level.open")).alias("target"))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most_epochs: int = 2, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", unknown: float = 0.5, least_weight: float = 0.01, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, taken.

    ``quality`` has a weight for a doc_id, once each; documents without one have the weight ``unknown``.
    Texts are measured before anything is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.md5(F.encode(text, "utf-8")).alias("sha"))
    grouped = rows.groupBy("doc_id", "source", "size", "sha").agg(F.count("*").alias("copies"))
    grouped = grouped.withColumn("weight", F.lit(None).cast("double")) if quality is None else grouped.join(quality.select("doc_id", F.col("weight").cast("double").alias("weight")), "doc_id", "left")
    weight = F.greatest(F.coalesce(F.nanvl("weight", F.lit(0.0)), F.lit(unknown)), F.lit(least_weight))
    grouped = materialize(grouped.withColumn("weight", weight), "sized")
    single = grouped.where("copies = 1").withColumn("copy", F.lit(1).cast("long"))
    # Copies of one row are numbered in blocks, dealt out before they become rows.
    blocks = grouped.where("copies > 1").withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES_AT_ONCE})"))).repartition(shuffle_parts(docs.sparkSession), "sha", "block")
    many = blocks.withColumn("copy", F.explode(F.expr(f"sequence(block * {COPIES_AT_ONCE} + 1, least(copies, (block + 1) * {COPIES_AT_ONCE}))"))).drop("block")
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit(" ")), F.col("copy").cast("string"), F.col("sha"))
    u = (F.conv(F.substring(F.md5(F.encode(name, "utf-8")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    drawn = single.unionByName(many).withColumn("tag", name).withColumn("draw", -F.log(u) / F.col("weight"))
    sizes = grouped.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.sum("copies").alias("n"))
    plan = targets(sizes.select("source", "source_size"), weights, percent, most_epochs).withColumn("slot", F.coalesce("source", F.lit("")))
    plan = plan.withColumn("nameless", F.col("source").isNull()).drop("source")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_epochs))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.when(F.col("source_size") > 0, F.floor(F.col("target") + F.lit(0.5)).cast("long") - F.col("epochs") * F.col("source_size")).otherwise(0).cast("long"))
    counts = sizes.select(F.coalesce("source", F.lit("")).alias("slot"), F.col("source").isNull().alias("nameless"), F.ceil(F.col("n") / cell_rows).alias("cells"))
    plan = materialize(plan.join(counts, ["slot", "nameless"]), "targets")
    drawn = drawn.withColumns({"slot": F.coalesce("source", F.lit("")), "nameless": F.col("source").isNull()}).join(plan, ["slot", "nameless"])
    drawn = drawn.withColumn("cell", F.floor((F.lit(1.0) - F.exp(-F.col("draw"))) * F.col("cells")))
    cells = drawn.groupBy("slot", "nameless", "cell").agg(F.sum("size").alias("sum"), F.first("rest").alias("rest"))
    cells = cells.withColumn("before", F.expr("coalesce(sum(sum) OVER (PARTITION BY slot, nameless ORDER BY cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    ends = materialize(cells.where("before <= rest AND before + sum > rest").select("slot", "nameless", F.col("cell").alias("end"), "before"), "ends")
    placed = drawn.join(ends, ["slot", "nameless"], "left")
    whole = placed.where("end IS NULL OR cell <> end").withColumn("fraction", F.when(F.col("end").isNull() | (F.col("cell") < F.col("end")), F.col("size")).otherwise(0))
    last = placed.where("cell = end").withColumn("sum", F.expr("before + coalesce(sum(size) OVER (PARTITION BY slot, nameless ORDER BY draw, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"))
    last = last.withColumn("fraction", F.least(F.col("size"), F.greatest(F.col("rest") - F.col("sum"), F.lit(0)))).drop("sum")
    taken = F.col("epochs") * F.col("size") + F.col("fraction")
    return whole.unionByName(last).select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def _sql(good: float = 1.0, unknown: float = 0.5, bad: float = 0.25) -> str:
    return rf"""
WITH q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5(coalesce(text, '')) AS sha, CASE WHEN quality > 0 THEN {good} WHEN quality IS NULL THEN {unknown} ELSE {bad} END::DOUBLE AS weight,
    row_number() OVER (PARTITION BY doc_id, source, text) AS copy FROM documents LEFT JOIN q USING (doc_id)
),
k AS (SELECT *, coalesce(doc_id::VARCHAR, ' ') || ':' || copy || ':' || sha AS tag, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, ' ') || ':' || copy || ':' || sha), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / weight AS draw FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1]::HUGEINT AS w, 2 * source_size::HUGEINT AS cap, sum(source_size) OVER () AS whole FROM s),
c AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS full_, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS open_ FROM w WINDOW o AS (ORDER BY cap::DOUBLE / w::DOUBLE, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, cap * 100 * open_ <= w * (whole * 150 - full_ * 100) AS is_full FROM c),
v AS (SELECT (whole * 150 - full_ * 100)::DOUBLE AS part, (open_ * 100)::DOUBLE AS open_ FROM l WHERE NOT is_full ORDER BY full_ LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE w::DOUBLE * (SELECT part FROM v) / (SELECT open_ FROM v) END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS epochs FROM t),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT - epochs * source_size ELSE 0 END AS rest FROM e),
o AS (SELECT k.*, source_size, target, epochs, rest, coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY draw, tag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (epochs * size + least(size, greatest(rest - before, 0)))::BIGINT AS taken FROM o
"""


ORACLE_SQL = _sql()
