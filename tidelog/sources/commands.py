"""The command language: one command per line, short or long verbs."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.functions.keys import parse_int32

#: Verbs with the number of words in the whole command.
VERBS = {"p": ("put", 3), "g": ("get", 2), "r": ("range", 3), "d": ("delete", 2), "l": ("load", 2), "s": ("print", 1), "h": ("help", 1), "q": ("quit", 1)}

HELP = """\
p|put <key> <val>   store a value
g|get <key>         print the value of a key, if it has one
r|range <a> <b>     print key:value for a <= key < b
d|delete <key>      remove a key
l|load <file>       put the pairs of a binary file
s|print             print levels, runs and files
h|help              print this table
q|quit              leave"""


def _by_name(path: str) -> list[str | int]:
    """Numbers in a name count by their value: part-100000 comes after part-99999."""
    return [int(x) if i % 2 else x for i, x in enumerate(re.split(r"([0-9]+)", path))]


def _files(fs, found) -> Iterator[str]:
    """The files of a JVM array of file statuses in the order of their names, folders by what they hold."""
    for x in sorted(found or [], key=lambda x: _by_name(x.getPath().toString())):
        if x.isDirectory():
            yield from _files(fs, [y for y in fs.listStatus(x.getPath()) if y.getPath().getName()[0] not in "_."])
        else:
            yield re.sub(r"([\\*?\[\]{}])", r"\\\1", x.getPath().toString())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, line) of a text file, in the order of the file; of a folder, file by file in the order of their names.

    The files are named one by one, as a listing of a folder comes in any order.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = ",".join(_files(fs, fs.globStatus(at))) or path
    return spark.sparkContext.textFile(names).zipWithIndex().map(lambda x: (x[1], x[0])).toDF("pos bigint, line string")


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines (without blank ones) plus op, a, b, file and error; a row has either an op or an error."""
    t = F.split(F.trim(F.regexp_replace(F.col(line), r"\s+", " ")), " ")
    # A generator keeps the optimizer from copying the tokenizer into each of the expressions below.
    d = lines.withColumn("_t", F.explode(F.array(t))).where(F.element_at("_t", 1) != "")
    verb, n = F.element_at("_t", 1), F.size("_t")
    # One lookup of verb and number of words: a chain of conditions would be copied into everything that uses op.
    known = {f"{v} {words}": short for short, (long, words) in VERBS.items() for v in (short, long)}
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    d = d.withColumn("op", F.element_at(table, F.concat_ws(" ", verb, n.cast("string"))))
    a = F.when(F.col("op").isin("p", "g", "r", "d"), parse_int32(F.try_element_at("_t", F.lit(2))))
    b = F.when(F.col("op").isin("p", "r"), parse_int32(F.try_element_at("_t", F.lit(3))))
    file = F.when(F.col("op") == "l", F.regexp_replace(F.try_element_at("_t", F.lit(2)), r'^"(.*)"$', "$1"))
    d = d.withColumn("a", a).withColumn("b", b).withColumn("file", file)
    bad = (F.col("op").isin("p", "g", "r", "d") & F.col("a").isNull()) | (F.col("op").isin("p", "r") & F.col("b").isNull())
    error = F.when(F.col("op").isNull(), "Unrecognized command").when(bad, "Not a 32-bit integer").when((F.col("op") == "r") & (F.col("a") > F.col("b")), "Range ends before it begins")
    d = d.withColumn("error", error)
    ok = F.col("error").isNull()
    return d.drop("_t").withColumns({c: F.when(ok, F.col(c)) for c in ("op", "a", "b", "file")})
