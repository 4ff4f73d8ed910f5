"""Sinks: all-or-nothing publication, FASTA writers, resumable appends."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators.tables import Spec, remaining, validate


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


class PublishError(Exception):
    """Names every table that failed and why; nothing was published."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with a text; False if it is there already. Of several writers one wins,
    where the file system creates files atomically."""
    fs, target = _fs(spark, path)
    try:
        out = fs.create(target, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _texts(spark: SparkSession, folder: str) -> dict[str, str]:
    """Names and texts of the small files in a folder; what was never finished is empty."""
    fs, target = _fs(spark, folder)
    if not fs.exists(target):
        return {}
    out = {}
    for status in fs.listStatus(target):
        if status.isFile():
            stream = fs.open(status.getPath())
            out[status.getPath().getName()] = bytes(stream.readAllBytes()).decode()
            stream.close()
    return out


def publish(spark: SparkSession, builders: dict[str, tuple[Spec, Callable[[], DataFrame]]], folder: str) -> dict[str, str]:
    """Builds, stores and validates every table in a staging folder; only if all are right
    does a file under the next free number in ``published`` name them. Two publishers can't
    take one number: the later one takes the next. A failure at any point, between writing
    and naming too, leaves what was published before."""
    run = uuid.uuid4().hex
    problems, paths = [], {}
    for name, (spec, build) in builders.items():
        path = f"{folder}/runs/{run}/{name}"
        try:
            build().write.parquet(path)
            problems += validate(spark.read.parquet(path), spec)
        except Exception as e:  # a builder's failure is a finding, like a broken rule
            problems.append(f"{name}: {type(e).__name__}: {str(e)[:200]}")
        paths[name] = path
    fs, staged = _fs(spark, f"{folder}/runs/{run}")
    if problems:
        fs.delete(staged, True)
        raise PublishError("; ".join(problems))
    number = _last(spark, folder)[0] + 1
    while not put_if_absent(spark, f"{folder}/published/{number:012d}", json.dumps(paths)):
        number += 1
    return paths


def _last(spark: SparkSession, folder: str) -> tuple[int, dict[str, str]]:
    """(number, tables) of the last publication; (0, {}) before the first. A number whose
    taker died before it wrote has no tables and counts as taken only."""
    found = _texts(spark, f"{folder}/published")
    whole = {name: json.loads(text) for name, text in found.items() if text.endswith("}")}
    return max(map(int, found), default=0), whole[max(whole)] if whole else {}


def published(spark: SparkSession, folder: str) -> dict[str, str]:
    """Tables of the last publication and their paths."""
    return _last(spark, folder)[1]


def write_fasta(df: DataFrame, folder: str, header: str, seq: str, by: str | None = None) -> None:
    """FASTA files, one folder for each value of ``by``."""
    text = F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(seq)).alias("value")
    if by:
        df.select(text, by).write.partitionBy(by).text(folder)
    else:
        df.select(text).write.text(folder)


def append_cells(cells: DataFrame, folder: str, keys: list[str], compute: Callable[[DataFrame], DataFrame]) -> int:
    """Computes and stores only the cells that the folder lacks; how many there were. A batch
    counts once its mark is there: what a killed run wrote is computed again."""
    spark = cells.sparkSession
    held = committed_cells(spark, folder)
    todo = cells if held is None else remaining(cells, held, keys)
    n = todo.count()
    if n:
        batch = uuid.uuid4().hex
        compute(todo).write.parquet(f"{folder}/batches/{batch}")
        put_if_absent(spark, f"{folder}/marks/{batch}", "done")
    return n


def committed_cells(spark: SparkSession, folder: str) -> DataFrame | None:
    """The cells of all marked batches; None before the first."""
    batches = sorted(name for name, text in _texts(spark, f"{folder}/marks").items() if text == "done")
    return spark.read.parquet(*[f"{folder}/batches/{b}" for b in batches]) if batches else None


def reusable(cache: DataFrame, contract: dict[str, object]) -> tuple[DataFrame | None, list[str]]:
    """(cache, []) if every contract column has its one value, else (None, what differs)."""
    if missing := [c for c in contract if c not in cache.columns]:
        return None, [f"no column {c}" for c in missing]
    seen = cache.agg(*[F.collect_set(F.col(c).cast("string")).alias(c) for c in contract]).first()
    wrong = [f"{c}: {sorted(seen[c])} is not {v}" for c, v in contract.items() if set(seen[c]) != {str(v)}]
    return (None, wrong) if wrong else (cache, [])


def upgraded(cache: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """A cache of an older contract with the columns it lacks, at their old values."""
    return cache.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in cache.columns})


@dataclass
class Upgrade:
    """A named way from an older cache to the next: what it is for, and what it does."""

    name: str
    applies: Callable[[DataFrame], bool]
    apply: Callable[[DataFrame], DataFrame]


def brought_up(cache: DataFrame, contract: dict[str, object], upgrades: list[Upgrade]) -> tuple[DataFrame | None, list[str], list[str]]:
    """(cache, names of the upgrades it took, []) if it meets the contract, upgraded in order
    where it must be; else (None, names, what still differs)."""
    taken: list[str] = []
    for way in upgrades:
        if reusable(cache, contract)[0] is not None:
            break
        if way.applies(cache):
            cache, taken = way.apply(cache), [*taken, way.name]
    found, wrong = reusable(cache, contract)
    return found, taken, wrong


def write_matrix(distances: DataFrame, folder: str, facts: dict[str, object]) -> None:
    """A labelled square matrix as CSV (zero diagonal, both triangles of pairs a < b) and
    its facts as JSON beside it. Labels are few: each is a column."""
    both = distances.select("a", "b", "d").unionByName(distances.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    names = [r[0] for r in both.select("a").distinct().orderBy("a").collect()]
    diagonal = distances.sparkSession.createDataFrame([(n, n, 0.0) for n in names], both.schema)
    both.unionByName(diagonal).groupBy("a").pivot("b", names).agg(F.first("d")).withColumnRenamed("a", "label").coalesce(1).write.csv(f"{folder}/matrix", header=True)
    spark = distances.sparkSession
    spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "fact string, value string").coalesce(1).write.json(f"{folder}/facts")


def markdown(df: DataFrame, columns: list[str], order: list[str]) -> str:
    """A small table as a markdown table, rows in order."""
    rows = df.select(*columns).orderBy(*order).collect()
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(columns), line(["---"] * len(columns)), *(line(["" if x is None else str(x) for x in r]) for r in rows)])


def between_markers(text: str, begin: str, end: str, new: str) -> str:
    """text with what stands between two marker lines replaced; an error without them."""
    head, found, rest = text.partition(begin)
    old, closed, tail = rest.partition(end)
    if not found or not closed:
        raise ValueError(f"markers {begin!r} and {end!r} are needed")
    return f"{head}{begin}\n{new}\n{end}{tail}"


def invariant_copies(df: DataFrame, name: str, layer: str, keys: list[str], value: str) -> DataFrame:
    """(name, checksum, n_layers, invariant): a checksum of each baseline's rows, the same in
    every layer if it may be copied over: number of rows and sums over the parts of their whole
    md5, which the order of rows cannot change and no task has to gather."""
    md5 = F.md5(F.concat_ws("|", *keys, F.format_string("%.6f", F.col(value))))
    # 48 bits a row: a long would overflow from some 65,000 rows on
    part = lambda at: F.sum(F.conv(F.substring(md5, at, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    each = df.groupBy(name, layer).agg(F.concat_ws(":", F.count("*").cast("string"), part(1), part(13), part(25)).alias("checksum"))
    return each.groupBy(name).agg(F.min("checksum").alias("checksum"), F.count("*").alias("n_layers"), (F.count_distinct("checksum") == 1).alias("invariant"))
