"""Validation of a graph's raw records, before a schema is laid on them.

Records are variants, so what is absent, null and of another type stay apart.  Problems come as rows (section, place, nth, object,
problem): place is a record's place in its collection, nth the place of the check among a record's, so (section, place, nth) is the order
in which a reader of the document meets them.  All are told at once; a collection that is missing or no list counts as
empty.  object is the record's id as JSON, or its place where it has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vocabulary

NODE_KEYS, EDGE_KEYS = ("id", "type", "label"), ("id", "type", "from", "to")
ROW = "section string, place long, nth int, object string, problem string"


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(envelope, nodes, edges) of a graph's JSON document: envelope one row (body), the others (place, body)."""
    text = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("body"))
    return text, *(collection(text, name) for name in ("nodes", "edges"))


def collection(envelope: DataFrame, name: str) -> DataFrame:
    """(place, body) of the records of a list; none where it is no list."""
    some = envelope.select(F.when(_kind(_at("body", name)) == "ARRAY", _at("body", name)).alias("list")).where("list IS NOT NULL")
    some.createOrReplaceTempView(view := f"plumbline_{name}")
    return some.sparkSession.sql(f"SELECT CAST(pos AS BIGINT) AS place, value AS body FROM {view}, LATERAL variant_explode(list)")


def _at(body: str | Column, key: str) -> Column:
    """The value of a key: SQL null where it is absent, a variant null where it is null."""
    return F.try_variant_get(F.col(body) if isinstance(body, str) else body, f"$.{key}", "variant")


def _kind(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, VOID (null) and so on; SQL null for what is absent."""
    return F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)


def _text(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", value.cast("string"))


def envelope_problems(envelope: DataFrame) -> DataFrame:
    version, body = _at("body", "schema_version"), F.col("body")
    said = [
        (F.coalesce(_kind(body) != "OBJECT", F.lit(True)), F.lit("graph is no object")),
        (version.isNull(), F.lit("missing key schema_version")),
        (version.isNotNull() & ~F.coalesce(_text(version).isin(*vocabulary.SCHEMA_VERSIONS), F.lit(False)), F.lit("unsupported schema version")),
    ]
    for name in ("nodes", "edges"):
        value = _at("body", name)
        said += [(value.isNull(), F.lit(f"missing collection {name}")), (value.isNotNull() & (_kind(value) != "ARRAY"), F.lit(f"{name} is no list"))]
    whole = F.coalesce(_kind(body) == "OBJECT", F.lit(False))
    rows = F.array_compact(F.array(*[F.when(F.coalesce(c & (whole if k else F.lit(True)), F.lit(False)), F.struct(F.lit(k).alias("nth"), p.alias("problem"))) for k, (c, p) in enumerate(said)]))
    return envelope.select(F.explode(rows).alias("r")).select(F.lit("graph").alias("section"), F.lit(0).cast("long").alias("place"), "r.nth", F.lit("graph").alias("object"), "r.problem")


def _listed(df: DataFrame, section: str, said: list[tuple[Column, str]]) -> DataFrame:
    """A row a check that a record fails.  What is no object fails the first check alone."""
    whole = F.coalesce(F.col("kind") == "OBJECT", F.lit(False))
    checks = [(~whole, "is no object"), *[(whole & c, p) for c, p in said]]
    rows = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(k).alias("nth"), F.lit(p).alias("problem"))) for k, (c, p) in enumerate(checks)]))
    object_ = F.coalesce(F.to_json("id"), F.concat(F.lit("at "), F.col("place").cast("string")))
    return df.select("place", object_.alias("object"), F.explode(rows).alias("r")).select(F.lit(section).alias("section"), "place", "r.nth", "object", "r.problem")


def _known(value: str, words) -> Column:
    return F.coalesce(F.col(value).isin(*words), F.lit(False))


def problems(envelope: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All problems of a document; nodes and edges: place, body."""
    n = nodes.select("place", _kind(F.col("body")).alias("kind"), *[_at("body", k).alias(k) for k in NODE_KEYS])
    n = n.withColumns({"id_text": _text(F.col("id")), "type_text": _text(F.col("type")), "key": F.to_json("id")})
    # a record's own place among those of its id; records without one are no copies
    again = n.where("key IS NOT NULL").withColumn("copy", F.row_number().over(Window.partitionBy("key").orderBy("place"))).where("copy > 1").select(F.col("place").alias("c_place"))
    n = n.join(again, F.col("place") == F.col("c_place"), "left")
    said = [(F.col(k).isNull(), f"missing key {k}") for k in NODE_KEYS]
    said += [(F.col("type").isNotNull() & ~_known("type_text", vocabulary.NODE_TYPES), "unknown type"), (F.col("id").isNotNull() & F.col("id_text").isNull(), "id is no string"), (F.col("c_place").isNotNull(), "duplicate id")]
    found = [envelope_problems(envelope), _listed(n, "nodes", said)]

    ends = n.where("id_text IS NOT NULL AND kind = 'OBJECT'").groupBy(F.col("id_text").alias("end_id")).agg(F.min_by(F.struct("type_text"), "place").alias("t"))
    e = edges.select("place", _kind(F.col("body")).alias("kind"), *[_at("body", k).alias(k) for k in EDGE_KEYS], _at("body", "evidence").alias("evidence"))
    e = e.withColumns({"type_text": _text(F.col("type")), "is_evidence": F.coalesce(_kind(F.col("evidence")) == "OBJECT", F.lit(False))})
    e = e.withColumns({k: _text(_at("evidence", k)) for k in ("resolution",)} | {"evidence_kind": _text(_at("evidence", "kind")), "confidence": _at("evidence", "confidence")})
    for end in ("from", "to"):
        e = e.withColumn(f"{end}_text", _text(F.col(end)))
        e = e.join(ends.select(F.col("end_id").alias(f"{end}_id"), F.col("t.type_text").alias(f"{end}_type")), F.col(f"{end}_text") == F.col(f"{end}_id"), "left")
    legal = vocabulary.pairs_table(envelope.sparkSession).select(F.col("edge_type").alias("l_type"), F.col("from_type").alias("l_from"), F.col("to_type").alias("l_to"), F.lit(True).alias("legal"))
    e = e.join(F.broadcast(legal), (F.col("type_text") == F.col("l_type")) & (F.col("from_type") == F.col("l_from")) & (F.col("to_type") == F.col("l_to")), "left")
    evidence = F.col("is_evidence")
    said = [(F.col(k).isNull(), f"missing key {k}") for k in EDGE_KEYS]
    said += [
        (F.col("evidence").isNotNull() & ~evidence, "evidence is no object"),
        (evidence & ~_known("evidence_kind", vocabulary.EVIDENCE_KINDS), "unknown evidence kind"),
        (evidence & ~_known("resolution", vocabulary.RESOLUTIONS), "unknown evidence resolution"),
        (evidence & (F.col("evidence_kind") == "UNKNOWN") & F.col("confidence").isNotNull() & ~F.is_variant_null("confidence"), "unknown evidence with confidence"),
        (F.col("type").isNotNull() & ~_known("type_text", vocabulary.EDGE_TYPES), "unknown type"),
    ]
    for end in ("from", "to"):
        said += [(F.col(end).isNotNull() & F.col(f"{end}_text").isNull(), f"{end} is no string"), (F.col(f"{end}_text").isNotNull() & F.col(f"{end}_id").isNull(), f"dangling {end}")]
    known_ends = F.col("from_type").isNotNull() & F.col("to_type").isNotNull()
    said.append((known_ends & _known("type_text", vocabulary.EDGE_TYPES) & F.col("legal").isNull(), "illegal endpoints"))
    found.append(_listed(e, "edges", said))
    return reduce(DataFrame.unionByName, found)


def in_order(found: DataFrame) -> DataFrame:
    """As a reader of the document meets them: the graph's own, nodes', edges'."""
    return found.orderBy(F.array_position(F.array(*map(F.lit, ("graph", "nodes", "edges"))), F.col("section")), "place", "nth")
