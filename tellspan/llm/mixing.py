"""Mixing sources to target weights by Pfair scheduling, in built-in SQL functions only.

Time is a row of slots, one block of documents each. A source of weight q / Q owes its i-th block a
slot from its release, floor((i - 1) Q / q), to before its deadline, ceil(i Q / q). Giving each slot
to the released block with the earliest deadline meets all of them, so after any number of slots
each source has had its share to within less than one block. The pattern repeats after Q slots:
one period is scheduled, and blocks find their slots in it by arithmetic, wherever their rows are.

A source that runs out leaves its slots empty; the others keep their relative rates, and no
document is dropped or repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Documents of a source are dealt into so many buckets for numbering, by the first hex digits of a hash.
_DIGITS = 3


def shares(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, alpha: float = 0.5, resolution: int | None = None) -> DataFrame:
    """(s, q): of each source, slots out of sum(q). A null source is a source of its own.

    ``weights``: targets by source, which need not sum to one; sources without one get none of
    their own and get one slot each. Without ``weights``, targets are the document
    counts to the power of ``alpha``. Each source gets a slot at least. ``resolution`` defaults to
    1000, or to four slots a source where there are more than 250 sources.
    """
    counts = docs.groupBy(F.col(source_col).alias("s")).agg(F.count("*").alias("n"))
    if weights is None:
        w = F.pow(F.col("n").cast("double"), F.lit(alpha))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("s") == name, F.lit(float(value))).otherwise(w)
    every = Window.partitionBy(F.lit(1))  # a row for each source
    slots = F.lit(resolution) if resolution else F.greatest(F.lit(1000), 4 * F.count("*").over(every))
    return counts.select("s", w.alias("w"), slots.alias("r")).select("s", F.greatest(F.lit(1), F.round(F.col("r") * F.col("w") / F.sum("w").over(every))).cast("long").alias("q"))


def period(share: DataFrame, most_sources: int = 4000) -> DataFrame:
    """(s, q, total, j, slot): the slot of block j (from 0) of each source in one period of ``total`` slots.

    The table's size is bounded by the resolution, not by the data; more than ``most_sources`` sources are an error.
    """
    one = share.agg(F.sort_array(F.collect_list(F.struct(F.col("s").isNotNull().alias("known"), F.col("s"), F.col("q")))).alias("all"), F.sum("q").alias("total"))
    one = one.where(F.col("total").isNotNull()).withColumn("all", F.when(F.size("all") <= most_sources, F.col("all")).otherwise(F.raise_error(F.lit(f"more than {most_sources} sources"))))
    one = one.withColumn("q", F.transform("all", lambda x: x["q"]))
    pick = "array_min(filter(transform(a.n, (c, k) -> struct(((c + 1) * total + q[k] - 1) div q[k] as d, k as k, (c * total) div q[k] as r)), x -> x.r <= t)).k"
    run = f"""aggregate(sequence(0L, total - 1),
        struct(transform(q, x -> 0L) as n, cast(array() as array<int>) as picks),
        (a, t) -> element_at(transform(array({pick}), p -> struct(transform(a.n, (c, k) -> if(k = p, c + 1, c)) as n, concat(a.picks, array(p)) as picks)), 1),
        a -> a.picks)"""
    one = one.select("all", "total", F.posexplode(F.expr(run)).alias("slot", "k"))
    nth = Window.partitionBy("k").orderBy("slot")
    return one.select(F.expr("all[k].s").alias("s"), F.expr("all[k].q").alias("q"), "total", (F.row_number().over(nth) - 1).cast("long").alias("j"), F.col("slot").cast("long"))


def _placed(docs: DataFrame, block: int, source_col: str, id_col: str, whole: bool, options: dict) -> DataFrame:
    """(__id, __s, __n, __i, __q, __total, __at[, __row]): of each row its number in its source, its block, its source's slots
    in a period, and the slot of its block there. ``whole``: with the row itself as a struct, so that no name can clash."""
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row")] if whole else []
    d = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{source_col}`").alias("__s"), *row).withColumn("__h", F.md5(F.coalesce(F.col("__id").cast("string"), F.lit("")).cast("binary")))
    # a key that is never null, so that numbering and its join deal the rows out once
    d = d.withColumns({"__b": F.substring("__h", 1, _DIGITS), "__k": F.coalesce(F.concat(F.lit("="), F.col("__s")), F.lit(""))})
    sizes = d.groupBy("__k", "__b").agg(F.count("*").alias("c"))
    before = sizes.select(F.col("__k").alias("ok"), F.col("__b").alias("ob"), F.coalesce(F.sum("c").over(Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    within = F.row_number().over(Window.partitionBy("__k", "__b").orderBy("__h", "__id"))
    numbered = d.withColumn("__n", within).join(before, (F.col("__k") == F.col("ok")) & (F.col("__b") == F.col("ob"))).withColumn("__n", F.col("__n") + F.col("off") - 1)
    table = period(shares(docs.select(F.col(f"`{source_col}`").alias("s")), "s", **options))
    per = table.groupBy(F.col("s").alias("ps")).agg(F.max("q").alias("__q"), F.max("total").alias("__total"))
    out = numbered.join(F.broadcast(per), F.col("__s").eqNullSafe(F.col("ps"))).withColumn("__i", F.floor(F.col("__n") / block)).withColumn("__j", F.col("__i") % F.col("__q"))
    slots = table.select(F.col("s").alias("ts"), F.col("j").alias("tj"), F.col("slot").alias("__at"))
    return out.join(F.broadcast(slots), F.col("__s").eqNullSafe(F.col("ts")) & (F.col("__j") == F.col("tj")))


_SLOT = "(__i div __q) * __total + __at"


def schedule(docs: DataFrame, block: int = 16, source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """(id, source, nth, block, release, deadline, slot), a row for each row of ``docs``; options as in ``shares``.

    Documents of a source are numbered in the order of their hashed ids (null ids first), ``block``
    to a block. The mix is the order of (slot, nth). Numbers come from counts by source and hash
    bucket, so that a source with a third of all rows is numbered by many tasks. A null source is a source of its own; rows
    that repeat an id are numbered one after the other; other columns are not read. An empty table gives no rows.
    """
    return _placed(docs, block, source_col, id_col, False, options).select(
        F.col("__id").alias(id_col),
        F.col("__s").alias(source_col),
        F.col("__n").cast("long").alias("nth"),
        F.col("__i").cast("long").alias("block"),
        F.expr("(__i * __total) div __q").alias("release"),
        F.expr("((__i + 1) * __total + __q - 1) div __q").alias("deadline"),
        F.expr(_SLOT).alias("slot"),
    )


def mixed(docs: DataFrame, block: int = 16, partitions: int | None = None, source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs``, each once and unchanged, in the order of the mix: ranges of slots by partition, sorted within.

    ``partitions`` defaults to the session's shuffle partitions. Columns may have any names; nulls as in ``schedule``.
    """
    spark = docs.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = _placed(docs, block, source_col, id_col, True, options).select(F.expr(_SLOT).alias("__slot"), "__n", "__row")
    return out.repartitionByRange(parts, "__slot", "__n").sortWithinPartitions("__slot", "__n").select("__row.*")


ORACLE = """
WITH RECURSIVE sized AS (SELECT source AS s, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
share AS (SELECT s, greatest(1, round(1000 * w / (SELECT sum(w) FROM sized)))::BIGINT AS q FROM sized),
ordered AS (SELECT s, q, (row_number() OVER (ORDER BY s NULLS FIRST))::BIGINT AS k, (sum(q) OVER ())::BIGINT AS total FROM share),
lists AS (SELECT list(q ORDER BY k) AS q, max(total)::BIGINT AS total FROM ordered),
run(t, n, p) AS (
  SELECT -1::BIGINT, list_transform(q, lambda x: 0::BIGINT), 0::BIGINT FROM lists
  UNION ALL
  SELECT t, list_transform(n, lambda c, k: CASE WHEN k = p THEN c + 1 ELSE c END), p FROM (
    SELECT r.t + 1 AS t, r.n AS n,
      list_min(list_filter(list_transform(r.n, lambda c, k: CASE WHEN (c * l.total) // l.q[k] <= r.t + 1 THEN ((c + 1) * l.total + l.q[k] - 1) // l.q[k] * 100000 + k END), lambda v: v IS NOT NULL)) % 100000 AS p
    FROM run r, lists l WHERE r.t + 1 < l.total)),
slots AS (SELECT p AS k, t AS slot, row_number() OVER (PARTITION BY p ORDER BY t) - 1 AS j FROM run WHERE t >= 0),
numbered AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS nth FROM documents)
SELECT doc_id, source, nth::BIGINT AS nth, (nth // 16)::BIGINT AS block, ((nth // 16) * total // q)::BIGINT AS release, (((nth // 16) + 1) * total + q - 1) // q AS deadline,
  ((nth // 16) // q) * total + slot AS slot
FROM numbered JOIN ordered ON source IS NOT DISTINCT FROM s JOIN slots ON slots.k = ordered.k AND slots.j = (nth // 16) % q
"""
