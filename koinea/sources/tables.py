"""Readers: delimited corpora, position-linked files, resources; every reader declares or checks its columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from koinea.functions.text import normalize_text, parse_pairs


class MissingColumns(ValueError):
    """A table lacks required columns."""


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df, if it has all columns."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumns(f"missing columns: {', '.join(missing)}")
    return df


def read_delimited(spark: SparkSession, path: str | list[str], *, sep: str = "\t", schema: T.StructType | str | None = None, require_columns: Sequence[str] = ()) -> DataFrame:
    """A delimited file with a header; strings unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", '"')
    return require((reader.schema(schema) if schema else reader).csv(path), require_columns)


def read_city_corpora(spark: SparkSession, folder: str, cities: dict[str, str]) -> DataFrame:
    """All city files of a parallel corpus in one scan, long: (sent_id, split, variety, sent). cities: file stem -> variety."""
    raw = read_delimited(spark, [f"{folder}/{stem}.tsv" for stem in cities], require_columns=["sentID.BTEC", "split", "sent"])
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+)\.tsv$", 1)
    names = F.create_map(*[x for k, v in cities.items() for x in (F.lit(k), F.lit(v))])
    return raw.select(F.col("`sentID.BTEC`").alias("sent_id"), "split", F.element_at(names, stem).alias("variety"), "sent")


def wide_corpus(long: DataFrame, base: str, varieties: Sequence[str]) -> DataFrame:
    """The long corpus with a column for each variety, for the sentences of the base variety."""
    keep = long.where(F.col("variety") == base).select("sent_id").distinct()
    return long.join(keep, "sent_id", "left_semi").groupBy("sent_id").pivot("variety", list(varieties)).agg(F.first("sent"))


def normalized_columns(df: DataFrame, columns: Sequence[str], fold: bool = True) -> DataFrame:
    """df with the texts of columns normalised; nulls stay null."""
    return df.withColumns({c: normalize_text(F.col(c), fold) for c in columns})


def read_wide_corpus(spark: SparkSession, path: str, varieties: Sequence[str], fold: bool = True) -> DataFrame:
    """A wide corpus with all varieties checked and normalised; nulls stay null."""
    return normalized_columns(read_delimited(spark, path, require_columns=varieties), varieties, fold)


def read_raw_and_coda(spark: SparkSession, folder: str, cities: dict[str, str], base: DataFrame, parts: Sequence[str] = ("train", "test")) -> DataFrame:
    """Raw and CODA sentences of several cities beside the base corpus: base's columns and <variety>_raw, <variety>_CODA.

    cities: file stem -> variety; files are <folder>/<part>/<part>.<stem>.tsv. Sentences of any city that base
    (with sentID.BTEC) has are kept, and texts are normalised with folded letters. Of several rows of a
    city for one sentence the smallest texts count.
    """
    paths = [f"{folder}/{part}/{part}.{stem}.tsv" for part in parts for stem in cities]
    raw = read_delimited(spark, paths, require_columns=["sentID.BTEC", "raw", "CODA"])
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/.]+)\.tsv$", 1)
    names = F.create_map(*[x for k, v in cities.items() for x in (F.lit(k), F.lit(v))])
    told = raw.select(F.col("`sentID.BTEC`").alias("_id"), F.element_at(names, stem).alias("_v"), "raw", "CODA")
    own = lambda v, c: F.min(F.when(F.col("_v") == v, F.col(c))).alias(f"{v}_{c}")
    wide = told.groupBy("_id").agg(*[own(v, c) for v in cities.values() for c in ("raw", "CODA")])
    joined = base.join(wide, F.col("`sentID.BTEC`") == F.col("_id")).drop("_id")
    return normalized_columns(joined, [f"{v}_{c}" for v in cities.values() for c in ("raw", "CODA")])


def first_folder(spark: SparkSession, candidates: Sequence[str], *needed: str) -> str:
    """The first candidate folder that holds all needed files, on any file system Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in candidates:
        inside = [jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}") for name in needed]
        if all(p.getFileSystem(conf).exists(p) for p in inside):
            return folder
    raise FileNotFoundError(f"none of {', '.join(candidates)} holds {', '.join(needed)}")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of a text file. Line numbers are positions in the file, counted once over the whole file.

    A line's place in its split comes from the scan; the splits' line counts, one row for each, give where
    a split begins.
    """
    from pyspark.sql import Window

    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    splits = lines.groupBy("f", "b").agg(F.min("i").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(splits.select("f", "b", "first", before.alias("before")), ["f", "b"]).select((F.col("before") + F.col("i") - F.col("first")).alias("line_no"), "value")


def read_alignments(spark: SparkSession, pairs_path: str, ids_path: str) -> DataFrame:
    """Alignment lines joined by line number with their ids `row<TAB>variety`; the last line of an id counts."""
    ids = numbered_lines(spark, ids_path).select(
        "line_no", F.split("value", "\t").getItem(0).cast("long").alias("row_idx"), F.split("value", "\t").getItem(1).alias("variety")
    )
    joined = numbered_lines(spark, pairs_path).select("line_no", parse_pairs(F.col("value")).alias("pairs")).join(ids, "line_no")
    return joined.groupBy("row_idx", "variety").agg(F.max_by("pairs", "line_no").alias("pairs"))


def read_paired_blocks(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Two line-aligned files whose sentences end where both have a blank line: (sent_no, pos, raw, coda)."""
    from pyspark.sql import Window

    a, b = (numbered_lines(spark, p) for p in (left, right))
    both = a.withColumnRenamed("value", "raw").join(b.withColumnRenamed("value", "coda"), "line_no")
    blank = (F.trim("raw") == "") & (F.trim("coda") == "")
    at = Window.orderBy("line_no")  # one file of word pairs, not a corpus
    marked = both.withColumn("_b", blank).withColumn("_new", (~F.col("_b") & F.coalesce(F.lag("_b").over(at), F.lit(True))).cast("long"))
    told = marked.withColumn("sent_no", F.sum("_new").over(at) - 1).where(~F.col("_b"))
    return told.select("sent_no", (F.row_number().over(Window.partitionBy("sent_no").orderBy("line_no")) - 1).alias("pos"), "raw", "coda")


def read_json_map(df: DataFrame, column: str) -> DataFrame:
    """df with a JSON object column as map<string,bigint>; also accepts the numeric wrappers of legacy files."""
    bare = F.regexp_replace(F.col(column), r"np\.\w+\(([^)]*)\)", "$1")
    return df.withColumn(column, F.from_json(bare, "map<string,bigint>"))


def read_scored_sentences(spark: SparkSession, path: str, labels: int = 11) -> DataFrame:
    """An evaluation table (sentence, n_valid, split) with generality = n_valid / labels."""
    df = read_delimited(spark, path, sep=",", schema="sentence string, n_valid int, split string")
    return df.withColumn("generality", F.col("n_valid") / F.lit(float(labels)))
