"""Scans: FASTA, annotation (GTF), JSON records, labelled matrices, cached embeddings.

All go through Spark's readers, so any store it reaches will do; parsing is by built-in
functions. Absent values (NaN, empty) become null here.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bases of a piece of a chromosome.
TILE = 1 << 20


def fasta(spark: SparkSession, path: str, *, field: int | None = 0, upper: bool = False, separator: str = "|") -> DataFrame:
    """(key, header, seq): key is a field of the header (field 0 where it is short; the
    whole header for None). A record starts at a ">" that begins a line. Of records of one
    key the last in the file stands."""
    rows = fasta_records(spark, path, upper=upper)
    parts = F.split("header", "\\" + separator)
    key = F.col("header") if field is None else F.coalesce(F.try_element_at(parts, F.lit(field + 1)), F.element_at(parts, 1))
    return rows.select(F.trim(key).alias("key"), "header", "seq", "at").groupBy("key").agg(F.max_by(F.struct("header", "seq"), "at").alias("r")).select("key", "r.header", "r.seq")


def fasta_records(spark: SparkSession, path: str, *, upper: bool = False) -> DataFrame:
    """(header, seq, file, at): every record, also those of one header; at orders them."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"))
    lines = raw.where(F.trim("value") != "").withColumn("l", F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^\\s*>", ""), "\n"))
    seq = F.regexp_replace(F.array_join(F.slice("l", 2, F.size("l")), ""), r"\s", "")
    return lines.select(F.trim(F.element_at("l", 1)).alias("header"), (F.upper(seq) if upper else seq).alias("seq"), "file", F.struct("file", "block", "pos").alias("at"))


def family_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(gene, species, gene_id, cds, group): records of headers gene|species|gene_id; shorter
    headers go. group is the file's name without its ending."""
    r = fasta_records(spark, path, upper=True).withColumn("f", F.split("header", r"\|")).where(F.size("f") >= 3)
    last = F.max_by(F.struct(F.col("f")[2].alias("gene_id"), F.col("seq").alias("cds")), "at")
    group = F.regexp_extract("file", r"([^/]+?)(\.[^/.]*)?$", 1)
    return r.groupBy(F.trim(F.col("f")[0]).alias("gene"), F.trim(F.col("f")[1]).alias("species"), group.alias("group")).agg(last.alias("r")).select("gene", "species", "r.gene_id", "r.cds", "group")


def locus_key(group: str = "group", species: str = "species"):
    """The key of a locus: <group>__<species>."""
    return F.concat_ws("__", group, species)


def transcript_sequences(records: DataFrame, wanted: DataFrame, transcript: str = "transcript_id") -> DataFrame:
    """(transcript, seq): sequences of wanted transcripts; versions after a dot don't count."""
    plain = records.select(F.regexp_replace(F.split("header", r"[\s|]")[0], r"\.\d+$", "").alias(transcript), "seq")
    return plain.join(wanted.select(F.regexp_replace(transcript, r"\.\d+$", "").alias(transcript)).distinct(), transcript, "left_semi")


def longest_per_gene(records: DataFrame, pattern: str = r"gene:([^\s.]+)", stop: bool = False) -> DataFrame:
    """(gene, seq): the longest sequence of each gene named in the headers; of equals the
    first seen where records tell their place (at, from fasta_records), else the first in key
    order. stop: strip asterisks (peptides)."""
    seq = F.regexp_replace("seq", r"\*", "") if stop else F.col("seq")
    first = "at" if "at" in records.columns else "key"
    x = records.select(F.regexp_extract("header", pattern, 1).alias("gene"), seq.alias("seq"), first).where("gene <> ''")
    w = Window.partitionBy("gene").orderBy(F.desc(F.length("seq")), first)
    return x.withColumn("r", F.row_number().over(w)).where("r = 1").select("gene", "seq")


_GTF = "chrom string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """Annotation rows with gene_id, gene_name, transcript_id and biotype as columns."""
    rows = spark.read.csv(path, sep="\t", comment="#", schema=_GTF, quote="")
    get = lambda name: F.nullif(F.regexp_extract("attributes", rf'(?:^|;)\s*{name} "([^"]*)"', 1), F.lit(""))
    return rows.withColumns({n: get(n) for n in ("gene_id", "gene_name", "transcript_id", "gene_biotype")}).withColumn("canonical", F.col("attributes").contains("Ensembl_canonical"))


def transcripts(annotation: DataFrame, genes: DataFrame | None = None) -> DataFrame:
    """(gene_id, transcript_id, chrom, strand, canonical, cds): CDS and stop codon
    intervals in order, with their total length. genes: ids to keep, joined before any
    further parsing."""
    a = annotation.where(F.col("feature").isin("CDS", "stop_codon", "transcript"))
    if genes is not None:
        a = a.join(genes.select("gene_id"), "gene_id", "left_semi")
    spans = F.array_sort(F.collect_list(F.when(F.col("feature") != "transcript", F.struct("start", "end"))))
    g = a.groupBy("gene_id", "transcript_id").agg(F.first("chrom").alias("chrom"), F.first("strand").alias("strand"), F.bool_or("canonical").alias("canonical"), spans.alias("cds"))
    return g.withColumn("cds_len", F.aggregate("cds", F.lit(0).cast("long"), lambda s, e: s + e["end"] - e["start"] + 1))


def json_records(spark: SparkSession, path: str, schema: T.StructType | str, *, multi_line: bool = False) -> DataFrame:
    """JSON rows; what cannot be read shows in _corrupt_record instead of failing the scan.
    Truncated compressed files give the rows before the damage."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*struct.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.option("ignoreCorruptFiles", "true").json(path, schema=wide, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", multiLine=multi_line)


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """df with NaN turned to null in every floating column."""
    return df.withColumns({f.name: F.when(~F.isnan(f.name), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def labelled_matrix(df: DataFrame, label: str) -> DataFrame:
    """(a, b, d) of a square table whose columns are named after its rows."""
    names = [c for c in df.columns if c != label]
    return df.unpivot([label], names, "b", "d").select(F.col(label).alias("a"), "b", F.col("d").cast("double").alias("d"))


def layers(spark: SparkSession, path: str, expected: int | None = None) -> DataFrame:
    """A table partitioned by layer; where ``expected`` is given, all of 0 to expected - 1
    must be there."""
    df = spark.read.option("basePath", path).parquet(path)
    if expected is not None:
        seen = {r[0] for r in df.select("layer").distinct().collect()}  # layers are few
        missing = sorted(set(range(expected)) - {int(x) for x in seen})
        if missing:
            raise ValueError(f"{path} lacks layers {missing}")
    return df


def ready_conditions(cache: DataFrame, condition: str, key: str, expected: int) -> DataFrame:
    """Conditions whose cache is complete."""
    return cache.groupBy(condition).agg(F.countDistinct(key).alias("n")).where(F.col("n") == expected).select(condition)


def first_that_has(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of the frames; of one key those of the first frame that has it."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f.join(out.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
    return out


def windows(df: DataFrame, seq: str, offset: str, prompt: int, length: str) -> DataFrame:
    """df with window: ``length`` bases from ``prompt`` after an offset."""
    return df.withColumn("window", F.substring(F.col(seq), F.col(offset) + prompt + 1, F.col(length)))


def gene_ids(annotation: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(gene_name, gene_id) of gene rows; names: the names to keep."""
    g = annotation.where(F.col("feature") == "gene").select("gene_name", "gene_id").where("gene_name IS NOT NULL").distinct()
    return g if names is None else g.join(names.select("gene_name").distinct(), "gene_name", "left_semi")


def canonical_transcripts(annotation: DataFrame) -> DataFrame:
    """(gene_id, transcript_id) of transcripts marked as canonical."""
    return annotation.where((F.col("feature") == "transcript") & F.col("canonical")).select("gene_id", "transcript_id").distinct()


def genome_tiles(genome: DataFrame, chrom: str = "chrom", seq: str = "seq", size: int = TILE) -> DataFrame:
    """(chrom, tile, bases): chromosomes cut in pieces of equal length, numbered from 0."""
    kind = dict(genome.dtypes)[chrom]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for name, bases in zip(pdf[chrom], pdf[seq]):
                starts = range(0, len(bases or ""), size)
                for first in range(0, len(starts), 16):
                    some = starts[first : first + 16]
                    yield pd.DataFrame({chrom: [name] * len(some), "tile": [s // size for s in some], "bases": [bases[s : s + size] for s in some]})

    return genome.select(chrom, seq).mapInPandas(run, f"{chrom} {kind}, tile long, bases string")


def genome_slices(loci: DataFrame, genome: DataFrame, key: str = "key", chrom: str = "chrom", start: str = "start", end: str = "end", strand: str = "strand", size: int = TILE) -> DataFrame:
    """loci with ``span``: their chromosome's bases from start to end (from 1, both
    included, what lies beyond it left out), the reverse complement on the minus strand; null
    without such a chromosome. key: what tells loci apart.

    Loci meet the tiles that they touch, and the pieces are put together: no locus carries a
    chromosome."""
    from strandline.functions.sequences import reverse_complement

    tiles = genome_tiles(genome, chrom, size=size)
    at = lambda c: F.floor((F.greatest(F.col(c), F.lit(1)) - 1) / size).cast("long")
    touched = loci.where(F.col(end) >= F.greatest(F.col(start), F.lit(1))).select(key, chrom, start, end, F.explode(F.sequence(at(start), at(end))).alias("tile"))
    own = touched.join(tiles, [chrom, "tile"])
    first = F.greatest(F.greatest(F.col(start), F.lit(1)) - 1 - F.col("tile") * size, F.lit(0))
    piece = F.substring("bases", first + 1, F.col(end) - F.col("tile") * size - first)
    parts = own.select(key, F.struct("tile", piece.alias("piece")).alias("p")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "").alias("s_"))
    known = genome.select(chrom).distinct().withColumn("known_", F.lit(True))
    j = loci.join(parts, key, "left").join(known, chrom, "left").withColumn("s_", F.when(F.col("known_"), F.coalesce("s_", F.lit(""))))
    return j.withColumn("span", F.when(F.col(strand) == "-", F.expr(reverse_complement("s_"))).otherwise(F.col("s_"))).drop("s_", "known_")


def by_layer_folder(spark: SparkSession, path: str, pattern: str = r"/layer_?(\d+)/") -> DataFrame:
    """CSV tables of a folder for each layer, layer read off the path; other folders go."""
    df = spark.read.csv(path, header=True, inferSchema=True, recursiveFileLookup=True)
    layer = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
    return df.withColumn("layer", F.nullif(layer, F.lit("")).cast("int")).where("layer IS NOT NULL")


def with_status(records: DataFrame, required: str) -> DataFrame:
    """records with ``status``: unreadable, missing (no value of the required field) or ok."""
    broken = F.col("_corrupt_record").isNotNull()
    return records.withColumn("status", F.when(broken, "unreadable").when(F.col(required).isNull(), "missing").otherwise("ok"))


def present_in_order(stack: DataFrame, manifest: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of a stack whose key the manifest lists, with the manifest's order."""
    return stack.join(manifest.select(key, order), key)


def resolved(tables: list[DataFrame], aliases: dict[str, list[str]], keys: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """(table, which column stands for each metric): the first table that has each metric
    under one of its names, in order; tables are joined on the keys."""
    out, evidence = None, {}
    for metric, names in aliases.items():
        for number, t in enumerate(tables):
            own = [n for n in names if n in t.columns]
            if own:
                part = t.select(*keys, F.col(own[0]).alias(metric))
                out = part if out is None else out.join(part, keys, "full")
                evidence[metric] = f"table {number}: {own[0]}"
                break
        else:
            raise ValueError(f"no table has {metric} under {names}")
    return out, evidence


def tidy_table(spark: SparkSession, name: str, folders: list[str]) -> DataFrame:
    """The Parquet table of a name in the first folder that has it."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return spark.read.parquet(f"{folder}/{name}")
    raise FileNotFoundError(f"no table {name} in {', '.join(folders)}: build it first")


def required(spark: SparkSession, path: str, how: str) -> str:
    """path, if it exists; else an error that tells how to get it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        raise FileNotFoundError(f"{path} is missing: {how}")
    return path


def missing_tools(tools: dict[str, str]) -> dict[str, str]:
    """The programs of a registry (program: what it is needed for) that this machine lacks."""
    import shutil

    return {name: need for name, need in tools.items() if shutil.which(name) is None}
