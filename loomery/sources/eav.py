"""Wide tables to entity-attribute-value cells, and the small tables around them.

Identifiers are deterministic: field_id = 100 * source + column ordinal (from 1), entity_id = 10^8 * source + key. Cells are
text; null cells are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Values as long as this or longer are not imported from raw sources.
LONGEST_VALUE = 1300
FIELDS_PER_SOURCE, ENTITIES_PER_SOURCE = 100, 100_000_000
#: Source ordinals and key columns of the driver's tables.
SOURCES = {"customer": (1, "c_custkey"), "supplier": (2, "s_suppkey"), "part": (3, "p_partkey"), "orders": (4, "o_orderkey")}


def fields(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """field_id, source_id, local_name of every column."""
    rows = [(FIELDS_PER_SOURCE * SOURCES[t][0] + i, SOURCES[t][0], c) for t, df in tables.items() for i, c in enumerate(df.columns, 1)]
    return spark.createDataFrame(rows, "field_id long, source_id long, local_name string")


def cells(name: str, df: DataFrame, columns: list[str] | None = None, longest: int | None = LONGEST_VALUE, as_double: bool = False) -> DataFrame:
    """field_id, entity_id, value of one table: non-null, non-empty, shorter than `longest`. One narrow pass, no shuffle."""
    source, key = SOURCES[name]
    wanted = [c for c in df.columns if columns is None or c in columns]
    kind = "double" if as_double else "string"
    pairs = F.array(*[F.struct(F.lit(FIELDS_PER_SOURCE * source + df.columns.index(c) + 1).cast("long").alias("field_id"), F.col(c).cast(kind).alias("value")) for c in wanted])
    out = df.select((F.lit(ENTITIES_PER_SOURCE * source) + F.col(key)).alias("entity_id"), F.explode(pairs).alias("cell")).select("cell.field_id", "entity_id", "cell.value")
    out = out.where("value IS NOT NULL")
    if not as_double:
        out = out.where("value <> ''")
        out = out if longest is None else out.where(F.length("value") < longest)
    return out


def text_columns(df: DataFrame) -> list[str]:
    """Columns whose text is the same in any engine: strings and whole numbers."""
    return [c for c, kind in df.dtypes if kind in ("string", "int", "bigint")]


def number_columns(df: DataFrame) -> list[str]:
    return [c for c, kind in df.dtypes if kind in ("double", "int", "bigint", "float")]


def import_wide(df: DataFrame, table: str, entity_key: str | None = None, source_key: str | None = None, skip: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """A wide table as sources, fields, entities and cells (string ids); without an entity key, rows are numbered in the order of their values.

    A source is named table/source-key ('0' without one); null and empty cells are dropped.
    """
    for c in (entity_key, source_key, *skip):
        if c is not None and c not in df.columns:
            raise ValueError(f"{table} has no column {c}")
    if entity_key is not None and entity_key == source_key:
        raise ValueError("a column is the entity key or the source key, not both")
    data = [c for c in df.columns if c not in (entity_key, source_key, *skip)]
    source = F.concat(F.lit(f"{table}/"), F.col(source_key).cast("string") if source_key else F.lit("0"))
    # Without a key, the number needs an order over the whole table, in one task; give a key for large tables.
    entity = F.col(entity_key).cast("string") if entity_key else F.row_number().over(Window.orderBy(*data)).cast("string")
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in data])
    long = df.select(source.alias("source"), entity.alias("entity"), F.explode(pairs).alias("c")).select("source", "entity", "c.field", "c.value")
    long = long.where("value IS NOT NULL AND value <> ''")
    return {
        "sources": df.select(source.alias("source")).distinct(),
        "fields": df.select(source.alias("source")).distinct().select("source", F.explode(F.array(*map(F.lit, data))).alias("field")),
        "entities": df.select(source.alias("source"), entity.alias("entity")).distinct(),
        "cells": long,
    }


def random_sources(sources: DataFrame, loaded: DataFrame, n: int, max_values: int = 10_000_000, seed: int = 0) -> DataFrame:
    """n sources not loaded yet, of at most max_values values, in the order of a seeded hash."""
    fresh = sources.where(F.col("n_values") <= max_values).join(loaded.select("source_id"), "source_id", "left_anti")
    return fresh.orderBy(F.md5(F.concat(F.col("source_id").cast("string"), F.lit(f"/{seed}"))), "source_id").limit(n)


def raw_source(data: DataFrame, source_id: Column | int) -> dict[str, DataFrame]:
    """Cells (source_id, entity_id, name, value) of a raw source as entities, fields and cells shorter than LONGEST_VALUE."""
    own = data.where(F.col("source_id") == source_id)
    return {
        "entities": own.groupBy("source_id", "entity_id").agg(F.count("value").alias("n_values")),
        "fields": own.groupBy("source_id", "name").agg(F.count("value").alias("n_values"), F.count_distinct("value").alias("n_distinct"), F.avg(F.length("value")).alias("avg_val_len")),
        "cells": own.where(F.col("value").isNotNull() & (F.length("value") < LONGEST_VALUE)),
    }


def import_random(data: DataFrame, loaded: DataFrame, n: int, max_values: int = 10_000_000, seed: int = 0) -> dict[str, DataFrame]:
    """n sources of raw cells (source_id, entity_id, name, value) that aren't loaded, drawn by a seeded hash, and their entities, fields and cells."""
    sizes = data.groupBy("source_id").agg(F.count("value").alias("n_values"))
    drawn = F.broadcast(random_sources(sizes, loaded, n, max_values, seed).select("source_id"))  # n rows
    own = data.join(drawn, "source_id")
    return {"sources": drawn, **raw_source(own, F.col("source_id"))}


def unload(tables: dict[str, DataFrame], sources: DataFrame) -> dict[str, DataFrame]:
    """The tables without these sources: what has a source_id by it, what has none by the fields and entities that go."""
    gone = sources.select("source_id").distinct()
    keys = {"source_id": gone}
    for name, key in (("fields", "field_id"), ("entities", "entity_id")):
        if name in tables:
            keys[key] = tables[name].join(gone, "source_id", "left_semi").select(key).distinct()
    out = {}
    for name, rows in tables.items():
        key = next((k for k in ("source_id", "field_id", "entity_id") if k in rows.columns and k in keys), None)
        out[name] = rows.join(keys[key], key, "left_anti") if key else rows
    return out


def attribute_dictionary(att_id: int, df: DataFrame, column: str) -> DataFrame:
    return df.select(F.lit(att_id).cast("long").alias("att_id"), F.col(column).cast("string").alias("value")).where("value IS NOT NULL")


def synonym_dictionary(att_id: int, df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.lit(att_id).cast("long").alias("att_id"), F.col(a).cast("string").alias("value_a"), F.col(b).cast("string").alias("value_b"))


def global_schema(df: DataFrame, column: str, derived_from: str = "WEB") -> DataFrame:
    """global_attributes from a column of names: id in name order, type TEXT, no threshold."""
    names = df.select(F.col(column).cast("string").alias("name")).where("name IS NOT NULL").distinct()
    return names.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("id"), "name", F.lit(derived_from).alias("derived_from"), F.lit("TEXT").alias("type"), F.lit(None).cast("double").alias("threshold"))


def attribute_template(template: DataFrame, attributes: DataFrame) -> DataFrame:
    """template_name and att_id: a template's attribute names joined to the global attributes in any case."""
    return template.join(attributes, F.lower(template["attribute"]) == F.lower(attributes["name"])).select("template_name", F.col("id").alias("att_id"))


def import_auxiliary(kind: str, df: DataFrame, columns: list[str], attributes: DataFrame, name: str | None = None) -> DataFrame:
    """Dispatch of the auxiliary imports: attdict, syndict, schema, template. An attribute is given by name."""
    if kind == "schema":
        return global_schema(df, columns[0])
    if kind == "template":
        return attribute_template(df.select(F.lit(name).alias("template_name"), F.col(columns[0]).alias("attribute")), attributes)
    if kind not in ("attdict", "syndict"):
        raise ValueError(f"no auxiliary import is called {kind}")
    made = attribute_dictionary(0, df, columns[0]) if kind == "attdict" else synonym_dictionary(0, df, *columns)
    own = attributes.where(F.col("name") == name).select(F.col("id").alias("att_id"))
    return made.drop("att_id").join(F.broadcast(own))  # one row: the attribute of that name


def training_mappings(fields_: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Attributes from tag codes, and mappings of the fields to them with confidence and authority 1."""
    codes = tags.select("tag_code").where("tag_code IS NOT NULL").distinct()
    attributes = codes.select(F.row_number().over(Window.orderBy("tag_code")).cast("long").alias("id"), F.col("tag_code").alias("name"))
    joined = fields_.join(tags, ["source_id", "local_name"]).join(attributes, F.col("tag_code") == F.col("name"))
    return attributes, joined.select(F.col("field_id").alias("local_id"), F.col("id").alias("global_id"), F.lit(1.0).alias("confidence"), F.lit(1.0).alias("authority")).distinct()


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def schema_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.databaseExists(name)


def view_exists(spark: SparkSession, name: str) -> bool:
    return any(t.name == name and t.tableType in ("VIEW", "TEMPORARY") for t in spark.catalog.listTables())


def schema_tables(spark: SparkSession, schema: str | None = None) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(schema))


def table_attributes(spark: SparkSession, table: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(table)]


def save(df: DataFrame, path: str, *partition_by: str) -> None:
    """A results table: overwritten as Parquet."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_any(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Parquet, or CSV with a header."""
    return spark.read.option("header", True).csv(path) if kind == "csv" else spark.read.format(kind).load(path)
