"""Queries that write files from the test tables through Spark and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators import panel, tables as T
from strandline.operators.lineage import shared_root
from strandline.plans import derived as D
from strandline.sources import files, publish

Q, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _folder(df: DataFrame) -> str:
    return f"{shared_root(df).rstrip('/')}/files-{uuid.uuid4().hex}"


_L = f"({D.LOCI_SQL})"


@query(f"SELECT CAST(key AS VARCHAR) AS key, upper(cds) AS seq FROM {_L}")
def fasta_scan(spark, sf_dir):
    """FASTA written by family and read by a header field; lines are folded."""
    x = D.loci(spark, sf_dir)
    folder = _folder(x)
    folded = F.concat(F.substring("cds", 1, 40), F.lit("\n"), F.expr("substr(cds, 41)"))
    publish.write_fasta(x.select(F.concat(F.lit("a>b|"), F.col("key").cast("string"), F.lit("|x")).alias("h"), F.lower(folded).alias("s"), F.regexp_replace("family", "[^A-Za-z0-9]", "_").alias("family")), folder, "h", "s", by="family")
    return files.fasta(spark, folder, field=1, upper=True).select("key", "seq")


@query(f"SELECT 'g' || key AS gene, species, 'id' || key AS gene_id, upper(cds) AS cds FROM {_L}")
def family_scan(spark, sf_dir):
    """A2: family FASTA; headers of fewer than three fields go."""
    x = D.loci(spark, sf_dir)
    folder = _folder(x)
    full = F.concat(F.lit("g"), F.col("key").cast("string"), F.lit("|"), F.col("species"), F.lit("|id"), F.col("key").cast("string"))
    publish.write_fasta(x.select(full.alias("h"), "cds").unionByName(x.select(F.lit("short|x").alias("h"), "cds")), folder, "h", "cds")
    return files.family_fasta(spark, folder).select("gene", "species", "gene_id", "cds")


@query(f"SELECT family || '__' || species AS locus, count(*) AS n FROM {_L} GROUP BY 1")
def locus_keys(spark, sf_dir):
    """A3: keys of loci."""
    return D.loci(spark, sf_dir).groupBy(files.locus_key("family", "species").alias("locus")).agg(F.count("*").alias("n"))


@query(f"SELECT 'T' || key AS transcript_id, cds AS seq FROM {_L} WHERE key % 3 = 0")
def transcript_scan(spark, sf_dir):
    """A5: sequences of wanted transcripts, whatever their version."""
    x = D.loci(spark, sf_dir)
    folder = _folder(x)
    name = F.concat(F.lit("T"), F.col("key").cast("string"))
    publish.write_fasta(x.select(F.concat(name, F.lit("."), (F.col("key") % 4).cast("string"), F.lit(" cds x")).alias("h"), "cds"), folder, "h", "cds")
    wanted = x.where("key % 3 = 0").select(F.concat(name, F.lit(".9")).alias("transcript_id"))
    return files.transcript_sequences(files.fasta_records(spark, folder), wanted)


def _gtf_lines(spark, sf_dir):
    """GTF text: a gene, a transcript, two CDS intervals and a stop codon for each part."""
    p = D.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    rows = F.explode(F.expr("""array(struct('gene' AS f, 0 AS s, 90 + p_size AS e), struct('transcript' AS f, 0 AS s, 90 + p_size AS e),
      struct('CDS' AS f, 0 AS s, 29 AS e), struct('CDS' AS f, 40 AS s, 60 + p_size AS e), struct('stop_codon' AS f, 61 + p_size AS s, 63 + p_size AS e))"""))
    x = p.withColumn("r", rows).select("*", "r.*")
    at = F.col("p_partkey") * 100
    attributes = F.concat(F.lit('gene_id "G'), F.col("p_partkey").cast("string"), F.lit('"; '), F.when(F.col("f") != "gene", F.concat(F.lit('transcript_id "T'), F.col("p_partkey").cast("string"), F.lit('"; '))).otherwise(""), F.lit('gene_name "N'), (F.col("p_partkey") % 500).cast("string"), F.lit('";'), F.when((F.col("p_partkey") % 2 == 0) & (F.col("f") == "transcript"), ' tag "Ensembl_canonical";').otherwise(""))
    line = F.concat_ws("\t", "p_brand", F.lit("x"), "f", (at + F.col("s")).cast("string"), (at + F.col("e")).cast("string"), F.lit("."), F.when(F.col("p_partkey") % 3 == 0, "-").otherwise("+"), F.lit("."), attributes)
    folder = _folder(p)
    x.select(line.alias("value")).write.text(folder)
    return files.gtf(spark, folder)


@query("SELECT 'G' || p_partkey AS gene_id, 'T' || p_partkey AS transcript_id, p_brand AS chrom, CASE WHEN p_partkey % 3 = 0 THEN '-' ELSE '+' END AS strand, CAST(30 + 21 + p_size + 3 AS BIGINT) AS cds_len, CAST(p_partkey * 100 AS BIGINT) AS first_start FROM part WHERE p_partkey % 5 <> 0")
def gtf_transcripts(spark, sf_dir):
    """CDS and stop intervals of wanted genes' transcripts."""
    genes = D.table(spark, sf_dir, "part").where("p_partkey % 5 <> 0").select(F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("gene_id"))
    return files.transcripts(_gtf_lines(spark, sf_dir), genes).select("gene_id", "transcript_id", "chrom", "strand", "cds_len", F.col("cds")[0]["start"].alias("first_start"))


@query("SELECT 'G' || p_partkey AS gene_id, 'T' || p_partkey AS transcript_id FROM part WHERE p_partkey % 2 = 0")
def gtf_canonical(spark, sf_dir):
    """A7."""
    return files.canonical_transcripts(_gtf_lines(spark, sf_dir))


@query("SELECT 'N' || (p_partkey % 500) AS gene_name, 'G' || p_partkey AS gene_id FROM part WHERE p_partkey % 500 < 50")
def gtf_gene_ids(spark, sf_dir):
    """A8."""
    names = spark.range(50).select(F.concat(F.lit("N"), F.col("id").cast("string")).alias("gene_name"))
    return files.gene_ids(_gtf_lines(spark, sf_dir), names)


@query(f"WITH g AS (SELECT family AS chrom, string_agg(upper(cds), '' ORDER BY key) AS seq FROM {_L} GROUP BY 1), l AS (SELECT p_partkey AS key, p_brand AS chrom, p_size AS s, p_size + 30 AS e, CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '+' END AS strand FROM part) SELECT key, CASE WHEN strand = '-' THEN reverse(translate(substr(seq, s, e - s + 1), 'ACGT', 'TGCA')) ELSE substr(seq, s, e - s + 1) END AS span FROM l JOIN g USING (chrom)")
def genome_slices(spark, sf_dir):
    """Slices of chromosomes by strand; chromosomes are joined from FASTA."""
    x = D.loci(spark, sf_dir)
    genome = x.groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "cds"))), lambda r: r["cds"]), "").alias("seq"))
    folder = _folder(x)
    publish.write_fasta(genome, folder, "family", "seq")
    loci = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("chrom"), F.col("p_size").alias("start"), (F.col("p_size") + 30).alias("end"), F.when(F.col("p_partkey") % 2 == 0, "-").otherwise("+").alias("strand"))
    return files.genome_slices(loci, files.fasta(spark, folder, field=None, upper=True).withColumnRenamed("key", "chrom")).select("key", "span")


@query("SELECT CAST(event_id % 6 AS INT) AS layer, event_type, count(*) AS n FROM events WHERE event_id % 6 <> 5 GROUP BY 1, 2")
def layer_folders(spark, sf_dir):
    """Layers read off folder names; folders without one are passed over."""
    e = D.table(spark, sf_dir, "events").select("event_id", "event_type")
    folder = _folder(e)
    for k in range(6):  # layers of a panel are few
        e.where(F.col("event_id") % 6 == k).coalesce(1).write.csv(f"{folder}/{'other' if k == 5 else f'layer_{k:02d}'}", header=True)
    return files.by_layer_folder(spark, folder).groupBy("layer", "event_type").agg(F.count("*").alias("n"))


@query("SELECT CAST(layer AS INT) AS layer, count(*) AS n FROM (SELECT event_id % 4 AS layer FROM events) GROUP BY 1")
def layer_panel(spark, sf_dir):
    """A panel that must have every layer."""
    e = D.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).cast("int").alias("layer"))
    folder = _folder(e)
    e.write.partitionBy("layer").parquet(folder)
    return files.layers(spark, folder, 4).groupBy("layer").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, o_totalprice AS x FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, -1.0 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0")
def first_file_wins(spark, sf_dir):
    """Of several tables the first that has a key supplies it."""
    o = D.table(spark, sf_dir, "orders")
    a = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("x"))
    b = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("k"), F.lit(-1.0).alias("x"))
    return files.first_that_has([a, b], ["k"])


@query("SELECT CASE WHEN event_id % 10 = 3 THEN 'unreadable' WHEN event_id % 10 = 7 THEN 'missing' ELSE 'ok' END AS status, count(*) AS n FROM events GROUP BY 1")
def json_status(spark, sf_dir):
    """A status for each JSON record; broken ones do not stop the scan."""
    e = D.table(spark, sf_dir, "events").select("event_id", "event_type")
    folder = _folder(e)
    text = F.when(F.col("event_id") % 10 == 3, F.lit('{"gene": ')).when(F.col("event_id") % 10 == 7, F.lit('{"other": 1}')).otherwise(F.to_json(F.struct(F.col("event_id").alias("gene"), "event_type")))
    e.select(text.alias("value")).write.text(folder)
    # read before counting: a scan of the broken-record column alone is not allowed
    r = files.json_records(spark, folder, "gene long, event_type string").select("gene", "event_type", "_corrupt_record")
    return files.with_status(r, "gene").withColumn("g", F.hash("gene", "event_type")).groupBy("status").agg(F.count("g").alias("n"))


@query(f"SELECT key FROM {_L} WHERE key % 2 = 0 AND key % 3 <> 0 AND family < 'Brand#40'")
def target_loci(spark, sf_dir):
    """Loci with positions that the manifest and the families list."""
    x = D.loci(spark, sf_dir).select("key", "family")
    positions, manifest = x.where("key % 2 = 0").select("key"), x.where("key % 3 <> 0")
    families = x.where("family < 'Brand#40'").select("family").distinct()
    return manifest.join(positions, "key", "left_semi").join(families, "family", "left_semi").select("key")


@query("SELECT user_id, event_type, count(*) FILTER (event_id % 4 = 0) AS kept FROM events GROUP BY 1, 2 HAVING count(*) FILTER (event_id % 4 = 0) = 0")
def missing_cells(spark, sf_dir):
    """JSON lines read back and the cells they lack."""
    e = D.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    folder = _folder(e)
    e.where("event_id % 4 = 0").write.json(folder, compression="gzip")
    got = files.json_records(spark, folder, "user_id long, event_type string, event_id long")
    return T.remaining(e.select("user_id", "event_type").distinct(), got, ["user_id", "event_type"]).withColumn("kept", F.lit(0).cast("long"))


@query("SELECT vec_id AS key, CAST(row_number() OVER (ORDER BY label, vec_id) AS INT) AS place, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS s FROM embeddings WHERE vec_id % 3 <> 0")
def stack_in_order(spark, sf_dir):
    """A stack restricted to listed keys, in the manifest's order."""
    e = D.embedded(spark, sf_dir)
    m = e.where("key % 3 <> 0").select("key", "family")
    before = panel.offsets(m.groupBy("family").agg(F.count("*").alias("n")), "family", "n")
    from pyspark.sql import Window

    m = m.withColumn("r", F.row_number().over(Window.partitionBy("family").orderBy("key"))).join(before, "family").select("key", (F.col("offset") + F.col("r")).cast("int").alias("place"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return files.present_in_order(e, m, "key", "place").select("key", "place", F.round(total, 4).alias("s"))


@query("SELECT a.n_name AS a, b.n_name AS b, CASE WHEN a.n_nationkey = b.n_nationkey THEN 0.0 ELSE round(abs(a.n_nationkey - b.n_nationkey) / 7.0, 6) END::DOUBLE AS d FROM nation a, nation b")
def matrix_round_trip(spark, sf_dir):
    """A labelled matrix written as CSV with its facts and read back."""
    n = D.table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    x, y = n.alias("x"), n.alias("y")
    d = x.join(y, F.col("x.n_name") < F.col("y.n_name")).select(F.col("x.n_name").alias("a"), F.col("y.n_name").alias("b"), F.round(F.abs(F.col("x.n_nationkey") - F.col("y.n_nationkey")) / 7.0, 6).alias("d"))
    folder = _folder(n)
    publish.write_matrix(d, folder, {"n": 25})
    return files.labelled_matrix(spark.read.csv(f"{folder}/matrix", header=True), "label")


@query("SELECT p_partkey, p_retailprice AS identity, p_size AS length FROM part")
def resolved_metrics(spark, sf_dir):
    """Metrics found under their aliases in the first table that has them."""
    p = D.table(spark, sf_dir, "part")
    out, evidence = files.resolved([p.select("p_partkey", "p_retailprice"), p.select("p_partkey", "p_size", "p_retailprice")], {"identity": ["ident", "p_retailprice"], "length": ["p_size"]}, ["p_partkey"])
    assert evidence == {"identity": "table 0: p_retailprice", "length": "table 1: p_size"}
    return out


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def csv_panel(spark, sf_dir):
    """A CSV of genes, filtered."""
    n = D.table(spark, sf_dir, "nation")
    folder = _folder(n)
    n.write.csv(folder, header=True)
    return spark.read.csv(folder, header=True, schema=n.schema).where("n_regionkey = 2").select("n_nationkey", "n_name")


@query(f"SELECT key, substr(cds, key % 5 + 30 + 1, 24) AS \"window\" FROM {_L}")
def target_windows(spark, sf_dir):
    """A24."""
    x = D.loci(spark, sf_dir).withColumn("off", (F.col("key") % 5).cast("int")).withColumn("n", F.lit(24))
    return files.windows(x, "cds", "off", 30, "n").select("key", "window")


@query("SELECT 'nation' AS name, CAST(25 AS BIGINT) AS n UNION ALL SELECT 'region', CAST(5 AS BIGINT)")
def publish_tables(spark, sf_dir):
    """B1: all tables or none: the second run has a broken table and changes nothing."""
    n, r = D.table(spark, sf_dir, "nation"), D.table(spark, sf_dir, "region")
    folder = _folder(n)
    specs = {"nation": (T.Spec("nation", ["n_name"], key=["n_nationkey"]), lambda: n), "region": (T.Spec("region", ["r_name"], key=["r_regionkey"]), lambda: r)}
    publish.publish(spark, specs, folder)
    try:
        publish.publish(spark, specs | {"nation": (T.Spec("nation", ["n_name"], key=["n_regionkey"]), lambda: n.limit(1).unionByName(n))}, folder)
        raise AssertionError("a broken table was published")
    except publish.PublishError:
        pass
    parts = [spark.read.parquet(path).agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, path in publish.published(spark, folder).items()]
    return parts[0].unionByName(parts[1])


@query("SELECT 'head' || chr(10) || '<!-- b -->' || chr(10) || '| r_regionkey | r_name |' || chr(10) || '| --- | --- |' || chr(10) || (SELECT string_agg('| ' || r_regionkey || ' | ' || r_name || ' |', chr(10) ORDER BY r_regionkey) FROM region) || chr(10) || '<!-- e -->' || chr(10) || 'tail' AS text")
def readme_table(spark, sf_dir):
    """A small table put between the markers of a text."""
    table = publish.markdown(D.table(spark, sf_dir, "region"), ["r_regionkey", "r_name"], ["r_regionkey"])
    text = publish.between_markers("head\n<!-- b -->\nold\n<!-- e -->\ntail", "<!-- b -->", "<!-- e -->", table)
    return spark.createDataFrame([(text,)], "text string")


@query("SELECT user_id AS gene, event_type AS condition, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def cell_cache(spark, sf_dir):
    """Cells computed once; a second and third run add only what is missing."""
    e = D.table(spark, sf_dir, "events").select(F.col("user_id").alias("gene"), F.col("event_type").alias("condition"))
    folder, cells = _folder(e), e.distinct()
    work = lambda c: e.join(c, ["gene", "condition"], "left_semi").groupBy("gene", "condition").agg(F.count("*").alias("n"))
    for part in (cells.where("gene % 2 = 0"), cells, cells):
        publish.append_cells(part, folder, ["gene", "condition"], work)
    return publish.committed_cells(spark, folder)


@query("""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT count(*) AS cells, sum(n) AS total FROM c)
 SELECT name AS cache, reused, upgrades, why, CASE WHEN reused THEN cells END AS cells, CASE WHEN reused THEN CAST(total AS BIGINT) END AS total FROM t, (VALUES ('same contract', true, '', ''), ('older contract', true, 'panel named, counts as longs', ''), ('other panel', false, 'panel named', 'panel: [''a''] is not b')) v(name, reused, upgrades, why)""")
def cache_contract(spark, sf_dir):
    """A cache of cells is taken only if its contract fits; an older one is brought up
    first, by named steps, and keeps its cells."""
    c = D.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    new = c.withColumns({"panel": F.lit("a"), "version": F.lit(2)})
    old = c.select("user_id", "event_type", F.col("n").cast("string").alias("count"), F.lit(1).alias("version"))
    ways = [
        publish.Upgrade("panel named", lambda x: "panel" not in x.columns, lambda x: publish.upgraded(x, {"panel": "a"})),
        publish.Upgrade("counts as longs", lambda x: "count" in x.columns, lambda x: x.withColumn("n", F.col("count").cast("long")).withColumn("version", F.lit(2)).drop("count")),
    ]
    out = None
    for name, cache, panel, some in (("same contract", new, "a", ways), ("older contract", old, "a", ways), ("other panel", new.drop("panel"), "b", ways[:1])):
        got, taken, why = publish.brought_up(cache, {"panel": panel, "version": 2}, some)
        facts = c.limit(1).select(F.lit(None).cast("long").alias("cells"), F.lit(None).cast("long").alias("total")) if got is None else got.agg(F.count("*").alias("cells"), F.sum("n").alias("total"))
        row = facts.select(F.lit(name).alias("cache"), F.lit(got is not None).alias("reused"), F.lit(", ".join(taken)).alias("upgrades"), F.lit("; ".join(why)).alias("why"), "cells", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("WITH b AS (SELECT event_type AS name, layer, user_id, CASE WHEN event_type = 'click' THEN avg(value) + layer ELSE avg(value) END AS x FROM events, (SELECT unnest([0, 1, 2]) AS layer) GROUP BY 1, 2, 3), m AS (SELECT name, layer, count(*) || ':' || CAST(sum(CAST('0x' || substr(h, 1, 12) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 13, 12) AS BIGINT)) AS VARCHAR) || ':' || CAST(sum(CAST('0x' || substr(h, 25, 8) AS BIGINT)) AS VARCHAR) AS checksum FROM (SELECT *, md5(user_id || '|' || printf('%.6f', x)) AS h FROM b) GROUP BY 1, 2) SELECT name, min(checksum) AS checksum, count(*) AS n_layers, count(DISTINCT checksum) = 1 AS invariant FROM m GROUP BY 1")
def invariant_baselines(spark, sf_dir):
    """Checksums of baselines, alike in every layer or not."""
    e = D.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("name"), "user_id").agg(F.avg("value").alias("m"))
    b = e.withColumn("layer", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).withColumn("x", F.when(F.col("name") == "click", F.col("m") + F.col("layer")).otherwise(F.col("m")))
    return publish.invariant_copies(b, "name", "layer", ["user_id"], "x")
