"""Scans and sinks on files written here."""

import pytest
from pyspark.sql import functions as F

from strandline.operators.tables import Spec, validate
from strandline.sources import files, publish
from strandline.streaming import records


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">g1|sp1|id gene:E1.2\nacg\nTTT\n>g2|sp1\nAA\n>g1|sp2 gene:E1.3\nGGGG\n")
    got = {r["key"]: r["seq"] for r in files.fasta(spark, str(tmp_path / "x.fa"), upper=True).collect()}
    assert got == {"g1": "GGGG", "g2": "AA"}
    got = {r["key"]: r["seq"] for r in files.fasta(spark, str(tmp_path / "x.fa"), field=1).collect()}
    assert set(got) == {"sp1", "sp2 gene:E1.3"}
    whole = files.fasta(spark, str(tmp_path / "x.fa"), field=None)
    assert {r["gene"]: r["seq"] for r in files.longest_per_gene(whole).collect()} == {"E1": "acgTTT"}


def test_gtf(spark, tmp_path):
    row = 'chr1\tx\t{}\t{}\t{}\t.\t+\t.\tgene_id "G1"; transcript_id "T1"; gene_name "N"; tag "Ensembl_canonical";\n'
    (tmp_path / "a.gtf").write_text("#!x\n" + row.format("transcript", 1, 90) + row.format("CDS", 31, 60) + row.format("CDS", 1, 30) + row.format("stop_codon", 61, 63))
    t = files.transcripts(files.gtf(spark, str(tmp_path / "a.gtf"))).first()
    assert (t["gene_id"], t["transcript_id"], t["canonical"], t["cds_len"]) == ("G1", "T1", True, 63)
    assert [x["start"] for x in t["cds"]] == [1, 31, 61]


def test_json_and_matrix(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"a": 1, "b": "x"}\n{"a": \n')
    rows = files.json_records(spark, str(tmp_path / "r.json"), "a int, b string").collect()
    assert [r["a"] for r in rows] == [1, None] and rows[1]["_corrupt_record"]
    m = spark.createDataFrame([("x", 0.0, 2.0), ("y", 2.0, 0.0)], "name string, x double, y double")
    assert {(r["a"], r["b"], r["d"]) for r in files.labelled_matrix(m, "name").collect()} == {("x", "x", 0.0), ("x", "y", 2.0), ("y", "x", 2.0), ("y", "y", 0.0)}
    n = files.nulls_for_nan(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"))
    assert sorted(r["v"] is None for r in n.collect()) == [False, True]


def test_publish_is_all_or_nothing(spark, tmp_path):
    folder = f"file://{tmp_path}/pub"
    good = spark.range(3).withColumnRenamed("id", "k")
    spec = Spec("t", ["k"], key=["k"])
    publish.publish(spark, {"t": (spec, lambda: good)}, folder)
    with pytest.raises(publish.PublishError, match="bad"):
        publish.publish(spark, {"t": (spec, lambda: good), "bad": (Spec("bad", ["k"], key=["k"]), lambda: good.unionByName(good))}, folder)
    paths = publish.published(spark, folder)
    assert set(paths) == {"t"} and spark.read.parquet(paths["t"]).count() == 3


def test_validate_names_every_rule(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "layer int, family string")
    assert validate(df, Spec("t", ["layer", "rho"])) == ["t: no column rho"]
    found = validate(df, Spec("t", ["layer"], key=["layer"], distinct={"layer": 32}, complete=(["layer"], "family")))
    assert len(found) == 3


def test_append_and_reuse(spark, tmp_path):
    cells = spark.createDataFrame([("g", str(i)) for i in range(4)], "gene string, condition string")
    run = lambda c: publish.append_cells(c, f"file://{tmp_path}/cells", ["gene", "condition"], lambda d: d.withColumn("x", F.lit(1)))
    assert (run(cells.limit(2)), run(cells), run(cells)) == (2, 2, 0)
    cache = cells.withColumn("version", F.lit(2))
    assert publish.reusable(cache, {"version": 2})[1] == []
    assert publish.reusable(cache, {"version": 3})[1]


def test_two_publishers_and_a_killed_one(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/pub"
    tables = {n: spark.range(n).withColumnRenamed("id", "k") for n in (1, 2, 3)}
    put = lambda n: publish.publish(spark, {"t": (Spec("t", ["k"]), lambda: tables[n])}, folder)
    rows = lambda: spark.read.parquet(publish.published(spark, folder)["t"]).count()
    put(1)
    # both read the same last number: one takes the next, the other the one after
    last = publish._last(spark, folder)
    monkeypatch.setattr(publish, "_last", lambda *a: last)
    put(2)
    put(3)
    monkeypatch.undo()
    assert publish._last(spark, folder)[0] == 3 and rows() == 3
    # killed between write and name: nothing is published
    monkeypatch.setattr(publish, "put_if_absent", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        put(1)
    monkeypatch.undo()
    assert rows() == 3
    # killed while it took its number: the number stays empty and readers pass over it
    assert publish.put_if_absent(spark, f"{folder}/published/{4:012d}", "") and not publish.put_if_absent(spark, f"{folder}/published/{4:012d}", "x")
    assert rows() == 3
    put(2)
    assert publish._last(spark, folder)[0] == 5 and rows() == 2


def test_unmarked_cells_are_computed_again(spark, tmp_path, monkeypatch):
    folder = f"file://{tmp_path}/cells"
    cells = spark.createDataFrame([("g", str(i)) for i in range(5)], "gene string, condition string")
    run = lambda c: publish.append_cells(c, folder, ["gene", "condition"], lambda d: d.withColumn("x", F.lit(1)))
    assert publish.committed_cells(spark, folder) is None and run(cells.limit(2)) == 2
    monkeypatch.setattr(publish, "put_if_absent", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        run(cells)
    monkeypatch.undo()
    assert publish.committed_cells(spark, folder).count() == 2
    assert run(cells) == 3 and publish.committed_cells(spark, folder).count() == 5


def test_upgrades_are_taken_in_order(spark):
    old = spark.createDataFrame([(1,), (2,)], "a int").withColumn("version", F.lit(1))
    step = lambda n: publish.Upgrade(f"to {n}", lambda c: c.first()["version"] == n - 1, lambda c: c.withColumn("version", F.lit(n)))
    cache, taken, wrong = publish.brought_up(old, {"version": 3}, [step(2), step(3), step(4)])
    assert cache.count() == 2 and taken == ["to 2", "to 3"] and wrong == []
    assert publish.brought_up(old, {"version": 9}, [step(3)]) == (None, [], ["version: ['1'] is not 9"])


@pytest.mark.parametrize("size", [7, 10, 1 << 20])
def test_slices_over_tile_borders(spark, size):
    seq = "".join("ACGT"[i * i % 7 % 4] for i in range(95))
    genome = spark.createDataFrame([("1", seq), ("2", "ACGTN")], "chrom string, seq string")
    rows = [(i, c, a, b, s) for i, (c, a, b, s) in enumerate([("1", 1, 95, "+"), ("1", 7, 7, "+"), ("1", 7, 8, "-"), ("1", 10, 31, "-"), ("1", 90, 200, "+"), ("2", 1, 5, "-"), ("3", 1, 2, "+"), ("1", 96, 99, "+"), ("1", 5, 4, "+")])]
    loci = spark.createDataFrame(rows, "key long, chrom string, start int, end int, strand string")
    got = {r["key"]: r["span"] for r in files.genome_slices(loci, genome, size=size).collect()}
    for key, c, a, b, strand in rows:
        whole = {"1": seq, "2": "ACGTN"}.get(c)
        want = None if whole is None else whole[a - 1 : b]
        if want is not None and strand == "-":
            want = want[::-1].translate(str.maketrans("ACGT", "TGCA"))
        assert got[key] == want


def test_checksums_do_not_depend_on_order(spark):
    rows = [("b", layer, k, float(k * k)) for layer in (0, 1) for k in range(20)]
    sums = [publish.invariant_copies(spark.createDataFrame(r, "name string, layer int, k int, x double"), "name", "layer", ["k"], "x").first() for r in (rows, rows[::-1], [*rows[:-1], ("b", 1, 19, 0.5)])]
    assert sums[0] == sums[1] and sums[0]["invariant"] and not sums[2]["invariant"]


def test_stream_drops_repeats(spark, tmp_path):
    rows = [("g", "c", i % 3, f"2024-01-01 00:0{i}:00") for i in range(6)]
    spark.createDataFrame(rows, "gene string, condition string, sample long, t string").selectExpr("gene", "condition", "sample", "CAST(t AS timestamp) AS ts").write.parquet(f"{tmp_path}/in")
    s = records.read(spark, f"{tmp_path}/in", "gene string, condition string, sample long, ts timestamp")
    records.ingest(s, f"file://{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
