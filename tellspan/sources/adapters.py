"""The driver's tables presented as telemetry, in canonical form, with the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EVENT, EXEMPLAR, KV, LINK, POINTS, attributes, kv


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ns(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp")) * 1000


def _hex(col: Column, n: int) -> Column:
    return F.lpad(F.lower(F.hex(col)), n, "0")


def _origin(row: Column) -> tuple[Column, ...]:
    return F.lit(0).cast("long").alias("node"), F.lit(0).cast("long").alias("seq"), row.cast("long").alias("row")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log records; errors are ERROR, purchases WARN, all else INFO."""
    e = _table(spark, sf_dir, "events")
    error, buy = F.col("event_type") == "error", F.col("event_type") == "purchase"
    return e.select(
        _ns(F.col("ts")).alias("ts_ns"),
        F.when(error, 17).when(buy, 13).otherwise(9).alias("severity_number"),
        F.when(error, "ERROR").when(buy, "WARN").otherwise("INFO").alias("severity_text"),
        F.col("event_type").alias("event_name"),
        F.concat("event_type", F.lit(" "), "props").alias("body"),
        _hex(F.col("user_id") * 1000 + F.col("event_id") % 1000, 32).alias("trace_id"),
        attributes(kv("service.name", F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")), "str"), kv("service.instance.id", F.concat(F.lit("user-"), F.col("user_id").cast("string")), "str")).alias("resource"),
        attributes().alias("scope"),
        attributes(kv("value", F.col("value"), "double"), kv("k", F.get_json_object("props", "$.k").try_cast("bigint"), "int")).alias("attrs"),
        *_origin(F.col("event_id")),
    )


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as root spans and their lines as children."""
    t = lambda n: _table(spark, sf_dir, n)
    orders = t("orders").join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    none = F.lit(None).cast("string")
    root = orders.select(
        _ns(F.col("o_orderdate")).alias("ts_ns"), F.lit(86_400_000_000_000).alias("duration_ns"), _hex(F.col("o_orderkey"), 32).alias("trace_id"), _hex(F.col("o_orderkey") * 2, 16).alias("span_id"), none.alias("parent_span_id"), F.lit("order").alias("name"), F.lit(2).alias("kind"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0).otherwise(2).alias("status_code"), F.col("c_mktsegment").alias("service"), (F.col("o_orderkey") * 2).alias("id"),
    )
    order = "l_orderkey l_linenumber l_partkey l_suppkey l_shipdate l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus".split()
    lines = _numbered(t("lineitem"), order).join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
    child = lines.select(
        _ns(F.col("l_shipdate")).alias("ts_ns"), (F.col("l_quantity").cast("bigint") * 1_000_000).alias("duration_ns"), _hex(F.col("l_orderkey"), 32).alias("trace_id"), _hex(F.col("rn") * 2 + 1, 16).alias("span_id"), _hex(F.col("l_orderkey") * 2, 16).alias("parent_span_id"), F.lit("line").alias("name"), F.lit(3).alias("kind"),
        F.when(F.col("l_returnflag") == "R", 2).when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("status_code"), F.col("n_name").alias("service"), (F.col("rn") * 2 + 1).alias("id"),
    )
    out = root.unionByName(child)
    return out.select("ts_ns", "duration_ns", "trace_id", "span_id", "parent_span_id", "name", "kind", "status_code", attributes(kv("service.name", F.col("service"), "str")).alias("resource"), attributes().alias("scope"), attributes().alias("attrs"), *_origin(F.col("id")))


def _numbered(lines: DataFrame, order: list[str]) -> DataFrame:
    """``rn``, each line's place in a total order: ranges of order keys are counted, then numbered apart."""
    bucket = F.floor(F.col("l_orderkey") / 4096)
    sizes = lines.groupBy(bucket.alias("bk")).agg(F.count("*").alias("c"))
    offsets = sizes.select(F.col("bk").alias("ok"), F.coalesce(F.sum("c").over(Window.orderBy("bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    ranked = lines.withColumn("bk", bucket).withColumn("r", F.row_number().over(Window.partitionBy("bk").orderBy(*order)))
    return ranked.join(offsets, F.col("bk") == F.col("ok")).withColumn("rn", F.col("r") + F.col("off"))


def convo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as traces, each turn the child of the one before."""
    c = _table(spark, sf_dir, "conversations")
    key = F.col("conv_id") * 100 + F.col("turn")
    return c.select(
        (F.lit(1_700_000_000_000_000_000) + F.col("conv_id") * 1_000_000_000 + F.col("turn") * 1_000_000).alias("ts_ns"),
        (F.length("text") * 1000).cast("long").alias("duration_ns"),
        _hex(F.col("conv_id"), 32).alias("trace_id"),
        _hex(key + 1, 16).alias("span_id"),
        F.when(F.col("turn") > 0, _hex(key, 16)).alias("parent_span_id"),
        F.lit("turn").alias("name"),
        F.lit(1).alias("kind"),
        F.lit(0).alias("status_code"),
        attributes(kv("service.name", F.col("role"), "str")).alias("resource"),
        attributes().alias("scope"),
        attributes().alias("attrs"),
        *_origin(key),
    )


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as log records, labels as attributes where there are any."""
    d = _table(spark, sf_dir, "documents").join(_table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select(
        (F.lit(1_700_000_000_000_000_000) + F.col("doc_id") * 1_000_000).alias("ts_ns"),
        F.lit(9).alias("severity_number"),
        F.lit("INFO").alias("severity_text"),
        F.col("text").alias("body"),
        attributes().alias("resource"),
        attributes().alias("scope"),
        attributes(kv("lang", F.col("lang"), "str"), kv("source", F.col("source"), "str"), kv("n_chars", F.col("n_chars"), "int"), kv("quality", F.col("quality"), "int"), kv("toxic", F.col("toxic"), "int")).alias("attrs"),
        *_origin(F.col("doc_id")),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two metrics of events: each one's value, and each user's count so far."""
    e = _table(spark, sf_dir, "events").select(_ns(F.col("ts")).alias("ts_ns"), "event_type", "value", "event_id", "user_id", F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")).alias("service"))
    kind = attributes(kv("event_type", F.col("event_type"), "str"))
    gauge = e.select("ts_ns", F.lit("event.value").alias("name"), F.lit("1").alias("unit"), F.lit("gauge").alias("kind"), F.lit(0).alias("temporality"), F.lit(False).alias("monotonic"), F.lit(None).cast("long").alias("v_int"), F.col("value").alias("v_dbl"), "service", kind.alias("attrs"), "event_id")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts_ns", "event_id"))
    total = e.select("ts_ns", F.lit("event.count").alias("name"), F.lit("{event}").alias("unit"), F.lit("sum").alias("kind"), F.lit(2).alias("temporality"), F.lit(True).alias("monotonic"), nth.cast("long").alias("v_int"), F.lit(None).cast("double").alias("v_dbl"), "service", attributes().alias("attrs"), "event_id")
    out = gauge.unionByName(total).select("*", attributes(kv("service.name", F.col("service"), "str")).alias("resource"), attributes().alias("scope"), attributes().alias("metric_attrs"), *_origin(F.col("event_id")))
    return out.select(*((F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in POINTS))


def _other(key: str, kind: int, **slots: Column) -> Column:
    """An attribute of a kind that ``kv`` doesn't make."""
    return F.struct(F.lit(key).alias("key"), F.lit(kind).cast("tinyint").alias("type"), *(slots.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in KV.fields[2:]))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as log records with attributes of every kind, at all three levels."""
    size, brand = F.col("p_size"), F.col("p_brand")
    return _table(spark, sf_dir, "part").select(
        (F.lit(1_700_000_000_000_000_000) + F.col("p_partkey") * 1_000_000).alias("ts_ns"),
        F.lit(9).alias("severity_number"),
        F.col("p_name").alias("body"),
        _hex(F.col("p_partkey") * 16 + 10, 16).alias("span_id"),
        attributes(kv("service.name", F.col("p_type"), "str"), kv("tier", size % 3, "int")).alias("resource"),
        attributes(kv("otel.scope.name", brand, "str"), kv("tier", F.lit("scope"), "str")).alias("scope"),
        attributes(
            kv("price", F.when(F.col("p_partkey") % 10 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")), "double"),
            kv("size", size, "int"),
            kv("large", size > 25, "bool"),
            kv("label", F.when(size % 2 == 0, size.cast("string")).otherwise(F.concat(F.lit("no. "), size.cast("string"))), "str"),
            kv("status", F.when(size % 5 == 0, F.lit("200")).otherwise(F.lit("true")), "str"),
            _other("raw", 5, bytes=F.encode("p_brand", "utf-8")),
            _other("list", 6, json=F.concat(F.lit("["), size.cast("string"), F.lit("]"))),
            _other("none", 0),
            F.when(size % 7 == 0, kv("size", size + 100, "int")),
        ).alias("attrs"),
        *_origin(F.col("p_partkey")),
    )


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as spans with two events and, for some, a link, each with attributes of its own."""
    o = _table(spark, sf_dir, "orders")
    child = lambda t, cols, attrs: F.struct(*((cols.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in t.fields if f.name != "attrs"), attrs.alias("attrs"))
    at = _ns(F.col("o_orderdate"))
    events = F.array(
        child(EVENT, {"ts_ns": at + 1, "name": F.lit("priority")}, attributes(kv("level", F.substring("o_orderpriority", 1, 1).cast("bigint"), "int"))),
        child(EVENT, {"ts_ns": at + 2, "name": F.lit("state")}, attributes(kv("state", F.col("o_orderstatus"), "str"))),
    )
    link = child(LINK, {"trace_id": _hex(F.col("o_custkey"), 32), "span_id": _hex(F.col("o_custkey"), 16)}, attributes(kv("customer", F.col("o_custkey"), "int")))
    return o.select(
        at.alias("ts_ns"), F.lit(1_000).cast("long").alias("duration_ns"), _hex(F.col("o_orderkey"), 32).alias("trace_id"), _hex(F.col("o_orderkey"), 16).alias("span_id"), F.lit("order").alias("name"),
        events.alias("events"), F.when(F.col("o_custkey") % 4 == 0, F.array(link)).otherwise(F.array().cast(T.ArrayType(LINK))).alias("links"),
        attributes(kv("service.name", F.lit("orders"), "str")).alias("resource"), attributes().alias("scope"), attributes(kv("level", F.lit(99), "int")).alias("attrs"), *_origin(F.col("o_orderkey")),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points of a histogram by priority, each with an exemplar; every third has no sum."""
    key = F.col("o_orderkey")
    exemplar = F.struct(*(({"ts_ns": F.col("ts_ns") - 1, "d": F.col("o_totalprice"), "span_id": _hex(key, 16)}.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in EXEMPLAR.fields))
    o = _table(spark, sf_dir, "orders").withColumn("ts_ns", _ns(F.col("o_orderdate")))
    out = o.select(
        "ts_ns", F.lit("order.price").alias("name"), F.lit("EUR").alias("unit"), F.lit("histogram").alias("kind"), F.lit(2).alias("temporality"), F.lit(False).alias("monotonic"),
        (key % 7 + 1).alias("count"), F.when(key % 3 > 0, F.col("o_totalprice")).alias("sum"), attributes(kv("priority", F.col("o_orderpriority"), "str")).alias("attrs"),
        attributes().alias("resource"), attributes().alias("scope"), attributes().alias("metric_attrs"), F.array(exemplar).alias("exemplars"), *_origin(key),
    )
    return out.select(*((F.col(f.name) if f.name in out.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in POINTS))


#: The views in DuckDB's dialect.
SQL = {
    "logs": """logs AS (SELECT epoch_us(ts)*1000 AS ts_ns, CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 ELSE 9 END AS severity_number,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END AS severity_text, event_type AS event_name, concat(event_type,' ',props) AS body,
  lpad(lower(to_hex(user_id*1000 + event_id%1000)),32,'0') AS trace_id, concat('svc-', (user_id%5)::VARCHAR) AS service, concat('user-', user_id::VARCHAR) AS instance, value, cast(json_extract(props,'$.k') AS BIGINT) AS k, event_id AS "row" FROM events)""",
    "spans": """spans AS (SELECT epoch_us(o_orderdate)*1000 AS ts_ns, 86400000000000 AS duration_ns, lpad(lower(to_hex(o_orderkey)),32,'0') AS trace_id, lpad(lower(to_hex(o_orderkey*2)),16,'0') AS span_id, NULL AS parent_span_id,
  'order' AS name, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 ELSE 2 END AS status_code, c_mktsegment AS service, o_orderkey*2 AS "row" FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT epoch_us(l_shipdate)*1000, cast(l_quantity AS BIGINT)*1000000, lpad(lower(to_hex(l_orderkey)),32,'0'), lpad(lower(to_hex(rn*2+1)),16,'0'), lpad(lower(to_hex(l_orderkey*2)),16,'0'),
  'line', CASE l_returnflag WHEN 'R' THEN 2 WHEN 'A' THEN 1 ELSE 0 END, n_name, rn*2+1
  FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey,l_linenumber,l_partkey,l_suppkey,l_shipdate,l_quantity,l_extendedprice,l_discount,l_tax,l_returnflag,l_linestatus) AS rn FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)""",
    "convo": """convo AS (SELECT 1700000000000000000 + conv_id*1000000000 + turn*1000000 AS ts_ns, (length(text)*1000)::BIGINT AS duration_ns, lpad(lower(to_hex(conv_id)),32,'0') AS trace_id, lpad(lower(to_hex(conv_id*100+turn+1)),16,'0') AS span_id,
  CASE WHEN turn > 0 THEN lpad(lower(to_hex(conv_id*100+turn)),16,'0') END AS parent_span_id, role AS service, conv_id*100+turn AS "row" FROM conversations)""",
    "docs": """docs AS (SELECT 1700000000000000000 + doc_id*1000000 AS ts_ns, text AS body, lang, source, n_chars, quality, toxic, doc_id AS "row" FROM documents LEFT JOIN labels USING (doc_id))""",
    "parts": """parts AS (SELECT 1700000000000000000 + p_partkey*1000000 AS ts_ns, p_name AS body, lpad(lower(to_hex(p_partkey*16+10)),16,'0') AS span_id, p_type AS service, p_size % 3 AS tier, p_brand AS scope_name,
  CASE WHEN p_partkey % 10 = 0 THEN 'NaN'::DOUBLE ELSE p_retailprice END AS price, p_size::BIGINT AS size, p_size > 25 AS large, CASE WHEN p_size % 2 = 0 THEN p_size::VARCHAR ELSE concat('no. ', p_size::VARCHAR) END AS label,
  CASE WHEN p_size % 5 = 0 THEN '200' ELSE 'true' END AS status, CASE WHEN p_size % 7 = 0 THEN p_size + 100 END AS size2, p_partkey AS "row" FROM part)""",
    "calls": """calls AS (SELECT epoch_us(o_orderdate)*1000 AS ts_ns, lpad(lower(to_hex(o_orderkey)),32,'0') AS trace_id, lpad(lower(to_hex(o_orderkey)),16,'0') AS span_id, substr(o_orderpriority,1,1)::BIGINT AS level, o_orderstatus AS state,
  CASE WHEN o_custkey % 4 = 0 THEN o_custkey END AS customer, o_orderkey AS "row" FROM orders)""",
    "prices": """prices AS (SELECT epoch_us(o_orderdate)*1000 AS ts_ns, o_orderkey % 7 + 1 AS n, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice END AS total, o_totalprice AS price, o_orderpriority AS priority,
  lpad(lower(to_hex(o_orderkey)),16,'0') AS span_id, o_orderkey AS "row" FROM orders)""",
}
