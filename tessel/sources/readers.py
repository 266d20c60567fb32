"""Readers and writers of files."""

import csv
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_spans(spark: SparkSession, path: str) -> DataFrame:
    """Annotations from CSV: (note_id, start, end, span, concept_id); offsets may be written as 12.0."""
    raw = spark.read.csv(path, header=True, schema="note_id string, start string, end string, span string, concept_id long", quote='"', escape='"', multiLine=True, nullValue="\\N")
    offset = lambda c: F.expr(f"try_cast(try_cast({c} AS double) AS int)")
    return raw.withColumn("start", offset("start")).withColumn("end", offset("end")).where("start IS NOT NULL AND end IS NOT NULL")


def read_note_texts(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(note_id, text) from CSV with quoted line breaks; the column may be named note_text; of a
    repeated id the first text in string order is kept; ``ids`` restricts the notes."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True)
    text = F.coalesce(*(F.col(c) for c in ("text", "note_text") if c in raw.columns))
    rows = raw.select("note_id", text.alias("text"))
    rows = rows.join(ids.select("note_id").distinct(), "note_id", "left_semi") if ids is not None else rows
    return rows.groupBy("note_id").agg(F.min("text").alias("text"))


def read_json_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(records with their file name, unreadable files) of a folder of whole-file JSON; nothing is left out unsaid."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    rows = text.select("file", F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return rows.where("r._corrupt IS NULL").select("r.*", "file").drop("_corrupt"), rows.where("r._corrupt IS NOT NULL").select("file")


LINKED = "chunk_id string, entities array<struct<snomed_cui:string,preferred_name:string,source_value:string,confidence_score:double,character_boundaries:struct<start:int,end:int>>>"


def read_linked_entities(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, snomed_cui, preferred_name, source_value, confidence_score, start, end) of linked-entity JSON lines.

    Null entities give no row; an unreadable line is a chunk without entities.
    """
    e = spark.read.schema(LINKED).option("mode", "PERMISSIVE").json(path).select("chunk_id", F.explode("entities").alias("e")).where("e IS NOT NULL")
    return e.select("chunk_id", "e.snomed_cui", "e.preferred_name", "e.source_value", "e.confidence_score", F.col("e.character_boundaries.start").alias("start"), F.col("e.character_boundaries.end").alias("end"))


def read_split_table(spark: SparkSession, path: str, names: tuple[str, ...] = ("train", "val", "test", "all")) -> DataFrame:
    """(note_id, split) of CSV files of any size with # comments; an unknown split is an error when it is read."""
    rows = spark.read.csv(path, header=True, comment="#", schema="note_id string, split string, n_gold_annotations int").select("note_id", "split")
    known = F.when(F.col("split").isin(*names), F.col("split")).otherwise(F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce("split", F.lit("null")))))
    return rows.withColumn("split", known)


def describe_tables(spark: SparkSession, tables: dict[str, DataFrame | None]) -> DataFrame:
    """(table_name, column_name, position) of the tables that are there; an absent one (None) has no rows."""
    rows = [(name, f.name, i) for name, df in sorted(tables.items()) if df is not None for i, f in enumerate(df.schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, column_name string, position int")


def read_training_rows(spark: SparkSession, path: str, schema: str, width: int) -> DataFrame:
    """JSON lines with a vector ``features`` of a fixed width; a row of another width is an error."""
    rows = spark.read.schema(schema).json(path)
    return rows.where(F.when(F.size("features") == width, True).otherwise(F.raise_error(F.concat(F.lit("a row has "), F.size("features").cast("string"), F.lit(f" features, not {width}"))).cast("boolean")))


def read_split_file(path: str, names: tuple[str, ...] = ("train", "val", "test", "all")) -> dict[str, str]:
    """{note_id: split} of a small CSV with # comments; an unknown split or an empty file is an error."""
    with Path(path).open(newline="") as f:
        rows = list(csv.DictReader(line for line in f if line.strip() and not line.startswith("#")))
    if not rows:
        raise ValueError(f"{path} names no notes")
    wrong = sorted({r["split"] for r in rows} - set(names))
    if wrong:
        raise ValueError(f"unknown splits: {', '.join(wrong)}")
    return {r["note_id"]: r["split"] for r in rows}


def sample_rows(df: DataFrame, key: Column, n: int) -> DataFrame:
    """``n`` rows by the order of the MD5 of a key: the same ones each time; each task keeps its first n."""
    return df.orderBy(F.md5(key)).limit(n)


def optional_table(spark: SparkSession, name: str) -> DataFrame | None:
    """A catalog table, or None where there is none."""
    return spark.table(name) if spark.catalog.tableExists(name) else None


def export_tables(tables: dict[str, DataFrame], folder: str, leave_out: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Write each table as parquet below a folder and return them as read back."""
    out = {}
    for name, df in tables.items():
        if name not in leave_out:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            out[name] = df.sparkSession.read.parquet(f"{folder}/{name}")
    return out
