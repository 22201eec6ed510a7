"""Folders of delimited files of any schema: one long table of values, and what each column of each file holds.

All files are read as lines in one scan. A file's delimiter is the candidate by which its lines agree best on a number of
fields, its header is its first line, and every line becomes a row a field: (number of its column, position, value).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profile import MAX_CODES, text_profile
from ..operators.scan import null_safe
from ..operators.selection import exact_medians
from ..staging import stage
from .delimited import MISSING
from .inventory import inventory, list_files

#: What may separate fields, the likelier first among those that do equally well.
CANDIDATES = (",", "\t", "|", ";")
# How truth values are written in delimited files.
TRUTH = {"True": 1.0, "TRUE": 1.0, "true": 1.0, "False": 0.0, "FALSE": 0.0, "false": 0.0}
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_QUOTED = '"(?:[^"]|"")*"'


def _literal(path: str) -> str:
    """A path in which no character is a pattern."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def read_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, block, at, line) of text files, staged: places are kept, so that later reads agree on them.

    `at` ascends inside a block and blocks by their place in the file. Lines without any character are left out, as blank lines of
    delimited files are.
    """
    raw = spark.read.text([_literal(p) for p in paths]).select("value", "_metadata.file_path", "_metadata.file_block_start")
    lines = raw.select(F.col("file_path").alias("file"), F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    return stage(lines.where("line <> ''"))


def field_count(bare: Column, delimiter: Column) -> Column:
    """Fields of a line whose quoted parts are taken out."""
    return F.length(bare) - F.length(F.replace(bare, delimiter, F.lit(""))) + 1


def sniff(lines: DataFrame, by_folder: bool = False) -> DataFrame:
    """(file, source, delimiter, first_at, header): the delimiter by which most lines agree on the most fields, and the first line.

    `source` is the file, or the folder it lies in where a table's rows are spread over the files of a folder. A file that no candidate divides has one column. Lines are counted by how many fields each candidate gives them, in one scan.
    """
    names = [f"by_{i}" for i in range(len(CANDIDATES))]
    bare = F.when(F.contains("line", F.lit('"')), F.regexp_replace("line", _QUOTED, "")).otherwise(F.col("line"))
    fields = [field_count(F.col("bare"), F.lit(d)).alias(n) for n, d in zip(names, CANDIDATES, strict=True)]
    shapes = stage(lines.select("file", "block", "at", bare.alias("bare")).groupBy("file", "block", *fields).agg(F.count("*").alias("n"), F.min("at").alias("at")))
    first = shapes.groupBy("file").agg(F.min(F.struct("block", "at")).alias("first")).select("file", F.col("first.at").alias("first_at"))
    each = F.array(*(F.struct(F.lit(-i).alias("rank"), F.lit(d).alias("delimiter"), F.col(n).alias("fields")) for i, (n, d) in enumerate(zip(names, CANDIDATES, strict=True))))
    counts = shapes.select("file", "n", F.explode(each).alias("c")).groupBy("file", "c.rank", "c.delimiter", "c.fields").agg(F.sum("n").alias("n"))
    likely = F.max(F.struct((F.col("fields") > 1).alias("divides"), "n", "fields", "rank", "delimiter")).alias("best")
    best = counts.groupBy("file").agg(likely).select("file", F.when(F.col("best.divides"), F.col("best.delimiter")).otherwise(CANDIDATES[0]).alias("delimiter"))
    known = stage(first.join(best, "file"))
    source = F.regexp_extract("file", "^(.*)/[^/]*$", 1) if by_folder else F.col("file")
    return stage(lines.join(known, "file").where("at = first_at").select("file", source.alias("source"), "delimiter", "first_at", F.col("line").alias("header")))


def split_fields(line: Column, delimiter: Column) -> Column:
    """The fields of a line as an array; quotes round a field are taken off, doubled quotes inside are one."""
    found = plain = F.lit(None).cast("array<string>")
    for d in reversed(CANDIDATES):
        pattern = f"{re.escape(d)}({_QUOTED}(?=$|{re.escape(d)})|[^{re.escape(d)}]*)"
        found = F.when(delimiter == d, F.regexp_extract_all(F.concat(F.lit(d), line), F.lit(pattern), F.lit(1))).otherwise(found)
        plain = F.when(delimiter == d, F.split(line, re.escape(d))).otherwise(plain)
    inner = lambda f: F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    unquoted = F.transform(found, lambda f: F.when(f.rlike(f"^{_QUOTED}$"), inner(f)).otherwise(f))
    return F.when(F.contains(line, F.lit('"')), unquoted).otherwise(plain)


def column_numbers(sniffed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, header, numbers, beyond) and (number, source, column, position): each (source, position, column) has one number, the
    fields of all lines of a source that are beyond a header share another one and have only positions.
    """
    names = F.transform(split_fields(F.regexp_replace("header", "^\ufeff", ""), F.col("delimiter")), lambda c: F.regexp_replace(c, "\r$", ""))
    headers = sniffed.select("source", "delimiter", "header", names.alias("columns")).distinct()
    fields = headers.select("source", F.posexplode("columns").alias("position", "column"))
    beyond = headers.select("source", F.lit(-1).alias("position"), F.lit(None).cast("string").alias("column"))
    known = stage(fields.unionByName(beyond).distinct().withColumn("number", F.monotonically_increasing_id()))
    placed = headers.select("source", "delimiter", "header", F.posexplode("columns").alias("position", "column")).join(known, ["source", "position", "column"])
    listed = placed.groupBy("source", "delimiter", "header").agg(F.array_sort(F.collect_list(F.struct("position", "number"))).alias("listed"))
    rest = known.where("position < 0").select("source", F.col("number").alias("beyond"))
    return listed.join(rest, "source").select("source", "delimiter", "header", F.col("listed.number").alias("numbers"), "beyond"), known


def numbered_values(lines: DataFrame, sniffed: DataFrame, numbers: DataFrame) -> DataFrame:
    """(number, position, value): every field of every line but the headers, missing values null.

    Fields that a short line lacks are null; those beyond the header have the number of these and their position.
    """
    known = stage(sniffed.join(numbers, ["source", "delimiter", "header"]).select("file", "delimiter", "first_at", "numbers", "beyond"))
    body = lines.select("file", "at", "line").join(known, "file").where("at <> first_at")
    line = F.when(F.contains("line", F.lit("\r")), F.regexp_replace("line", "\r$", "")).otherwise(F.col("line"))
    fields = body.select("delimiter", "numbers", "beyond", line.alias("line")).select("numbers", "beyond", split_fields(F.col("line"), F.col("delimiter")).alias("fields"))
    lacks = F.size("numbers") - F.size("fields")
    whole = F.when(lacks > 0, F.concat("fields", F.array_repeat(F.lit(None).cast("string"), lacks))).otherwise(F.col("fields"))
    each = fields.select("numbers", "beyond", F.posexplode(whole).alias("position", "value"))
    return each.select(F.coalesce(F.get("numbers", F.col("position")), "beyond").alias("number"), "position", F.when(~F.col("value").isin(MISSING), F.col("value")).alias("value"))


def profile_values(values: DataFrame, keys: Sequence[str], max_codes: int = MAX_CODES) -> DataFrame:
    """A row a column, named by `keys`, of (keys, value): kind, rows, nulls, and the figures of its kind.

    A column is of numbers if all its values are (truth values count as 1 and 0), else text; `empty` has no values. Values are written
    once; those of numbers meet only the medians' rounds, those of texts are counted by value. All columns share each job.
    """
    keys = list(keys)
    truth = F.create_map(*(F.lit(x) for pair in TRUTH.items() for x in pair))
    number = F.coalesce(F.when(F.col("v").rlike(_NUMBER), F.expr("try_cast(trim(v) AS double)")), truth[F.col("v")])
    read = stage(values.select(*keys, F.col("value").alias("v")).withColumns({"x": number, "valued": F.col("v").isNotNull()}))
    kind = F.when(F.count(F.when(F.col("valued"), 1)) == 0, "empty").when(F.count(F.when(F.col("valued") & F.col("x").isNull(), 1)) == 0, "number").otherwise("text")
    whole = stage(read.groupBy(*keys).agg(kind.alias("kind"), F.count("*").alias("n_rows"), F.count(F.when(~F.col("valued"), 1)).alias("n_null"), F.min("x").alias("low"), F.max("x").alias("high")))
    of = lambda name: read.join(whole.where(F.col("kind") == name).select(*keys), keys, "left_semi")
    texts = stage(of("text").where("valued").groupBy(*keys, "v").agg(F.count("*").alias("k")))
    medians = exact_medians(of("number").select(*keys, "x"), keys, "x").select(*keys, "median")
    found = null_safe(null_safe(whole, medians, keys, "left"), text_profile(texts, keys, max_codes), keys, "left")
    is_number = F.col("kind") == "number"
    return found.select(
        *keys, "kind", "n_rows", "n_null", F.when(is_number, F.col("low")).alias("least"), "median", F.when(is_number, F.col("high")).alias("greatest"),
        "n_distinct", "date_order", "codes", "samples",
    )


def inspect_files(spark: SparkSession, paths: Sequence[str], by_folder: bool = False, max_codes: int = MAX_CODES) -> DataFrame:
    """`profile_values` of delimited text files, with the delimiter found for each source. Quoted fields hold no line breaks."""
    lines = read_lines(spark, paths)
    sniffed = sniff(lines, by_folder)
    numbers, known = column_numbers(sniffed)
    found = profile_values(numbered_values(lines, sniffed, numbers), ["number", "position"], max_codes)
    delimiters = sniffed.groupBy("source").agg(F.min("delimiter").alias("delimiter"))
    named = found.join(known.select("source", "column", "number"), "number").join(delimiters, "source")
    return named.select("source", "position", "column", *found.columns[2:], "delimiter")


def inspect_folder(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame | None]:
    """(the inventory of a folder, the profile of its delimited files): files of an excluded theme or of other kinds are listed and not opened."""
    listed = inventory(list_files(spark, root))
    paths = [r.path for r in listed.where("kind = 'tabular' AND excluded_theme IS NULL").select("path").collect()]  # as Spark lists files itself
    return listed, inspect_files(spark, paths) if paths else None
