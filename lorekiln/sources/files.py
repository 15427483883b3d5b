"""Guarded readers and write-once sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from lorekiln.plans.order import with_ordinal


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame | None:
    """A CSV with a header and a declared schema; None where there is no file. A row that does not fit fails the read."""
    if not exists(spark, path):
        return None
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def read_json_batches(spark: SparkSession, pattern: str, schema: str | StructType | None = None) -> DataFrame:
    """JSON arrays, one file a job, as one table; keys missing in a file are null. With the file's name as source_file."""
    reader = spark.read.option("multiLine", True)
    reader = reader.schema(schema) if schema is not None else reader
    return reader.json(pattern).withColumn("source_file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """Whole text files: (name, text)."""
    files = spark.read.text(pattern, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("name"), F.col("value").alias("text"))


def chapters(texts: DataFrame, books: list[str] | None = None, numbers: list[int] | None = None, limit: int | None = None) -> DataFrame:
    """Files named {book}_chapter_{NN}.txt, by book prefix, then chapter number, sorted by name, then cut to ``limit``."""
    out = texts.withColumn("book", F.regexp_extract("name", r"^(.*)_chapter_\d+\.txt$", 1))
    out = out.withColumn("chapter", F.expr("try_cast(regexp_extract(name, '_chapter_([0-9]+)\\\\.txt$', 1) as int)"))
    out = out.where("book <> ''")
    if books is not None:
        any_book: Column = F.lit(False)
        for b in books:
            any_book = any_book | F.col("book").startswith(b)
        out = out.where(any_book)
    if numbers is not None:
        out = out.where(F.col("chapter").isin(numbers))
    out = out.orderBy("name")
    return out if limit is None else out.limit(limit)


def serialize_complex(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for sinks of flat columns."""
    kinds = (ArrayType, MapType, StructType)
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f.name) for f in df.schema])


def rehydrate(df: DataFrame, schema: StructType) -> DataFrame:
    """The inverse of ``serialize_complex`` for the columns that ``schema`` types as complex."""
    kinds = (ArrayType, MapType, StructType)
    typed = {f.name: f.dataType for f in schema if isinstance(f.dataType, kinds)}
    return df.select(
        *[F.from_json(f.name, typed[f.name]).alias(f.name) if f.name in typed and isinstance(f.dataType, StringType) else F.col(f.name) for f in df.schema]
    )


def compile_outputs(rows: DataFrame, text: str) -> DataFrame:
    """Model outputs, each a JSON list of objects: one row an item with its place (``item``), its JSON as it stands
    (``raw``) and its ``question`` (or ``question_text``). Texts that are no list, and items that are no objects, give
    no rows."""
    items = F.from_json(text, "array<string>")
    out = rows.select(*[c for c in rows.columns if c != text], F.posexplode(items).alias("item", "raw"))
    asked = F.coalesce(F.get_json_object("raw", "$.question"), F.get_json_object("raw", "$.question_text"))
    return out.where(F.col("raw").startswith("{")).withColumn("item", F.col("item").cast("long")).withColumn("question", asked)


def flatten_runs(spark: SparkSession, config: dict) -> DataFrame:
    """A plan of experiments and their runs (as read from YAML or JSON) as one row a run: a run's own settings go before
    the common ones, token counts are 0 where not given, and what the total has beyond its parts is hidden."""
    common, rows = config.get("common") or {}, []
    for e in config.get("experiments") or []:
        for r in e.get("runs") or []:
            n = {k: int((r.get("tokens") or {}).get(k) or 0) for k in ("cached", "uncached", "output", "total")}
            hidden = n["total"] - (n["cached"] + n["uncached"] + n["output"]) if n["total"] > 0 else 0
            both = {**common, **r}
            temperature = both.get("temperature")
            rows.append((e.get("name"), r.get("id"), both.get("model"), None if temperature is None else float(temperature), *n.values(), hidden))
    return spark.createDataFrame(rows, "experiment string, run_id string, model string, temperature double, cached long, uncached long, output long, total long, hidden long")


def parse_list_literal(c: Column) -> Column:
    """A list of words stored as the text of a Python list."""
    inner = F.regexp_extract(c, r"^\[(.*)\]$", 1)
    words = F.transform(F.split(inner, ", "), lambda x: F.regexp_replace(x, "^['\"]|['\"]$", ""))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(words)


def enforce_columns(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` cast to ``schema``, NaN as null; a null where the schema allows none stops the write, by row."""
    out = []
    for f in schema:
        c = F.col(f.name).cast(f.dataType)
        if f.dataType.typeName() in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        if not f.nullable:
            c = F.coalesce(c, F.raise_error(F.lit(f"null in {f.name}")).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def write_enforced(df: DataFrame, path: str, schema: StructType) -> None:
    """Parquet of exactly ``schema``; columns beyond it are left out, missing ones stop the write."""
    enforce_columns(df, schema).write.mode("errorifexists").parquet(path)


def versioned(base: str, name: str, version: str, sub: str | None = None) -> str:
    """Folder of one version of a table."""
    return "/".join([base.rstrip("/"), *([sub] if sub else []), f"{name}_{version}"])


def write_once(df: DataFrame, path: str, kind: str = "parquet") -> bool:
    """Write unless something is there; whether it was written."""
    if exists(df.sparkSession, path):
        return False
    df.write.mode("errorifexists").format(kind).save(path)
    return True


def write_batches(df: DataFrame, order: str, size: int, path: str) -> None:
    """JSON lines in folders of ``size`` consecutive rows (by ``order``); rows are numbered without one task for all."""
    numbered = with_ordinal(df, [order], "ordinal").withColumn("batch", F.floor(F.col("ordinal") / size)).drop("ordinal")
    numbered.write.mode("errorifexists").partitionBy("batch").json(path)
