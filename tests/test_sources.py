import gzip

import numpy as np
from pyspark.sql import functions as F

from sheetmill.sources import readers as R, writers as W


def test_headed_table_and_state_only(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text('A title, line\n"note"\nSymbol,Scientific Name,State,County,FIPS Code,Native Status\nPAXX,Packera x,North Carolina,Orange,37135,N\nPAXX,Packera x,Delaware,,,N\nPAXX,Packera x,New York,na,36031,NULL\n')
    (tmp_path / "b.csv").write_text("Symbol\tState\nPAYY\tMaine\n")
    (tmp_path / "c.csv").write_text("nothing\nhere\n")
    df = R.read_headed_table(spark, str(tmp_path))
    assert rows(df.select("file", "symbol", "state", "county", "native_status")) == [("a.csv", "PAXX", "Delaware", None, "N"), ("a.csv", "PAXX", "New York", None, None), ("a.csv", "PAXX", "North Carolina", "Orange", "N"), ("b.csv", "PAYY", "Maine", None, None)]
    assert rows(R.state_only(df)) == [("PAXX", "delaware", 1), ("PAXX", "new york", 1), ("PAXX", "north carolina", 0), ("PAYY", "maine", 1)]


def test_genotypes(spark, tmp_path, rows):
    text = "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS1\tS2\n1\t10\t.\tA\tC\t.\t.\t.\tGT:DP:AD\t0/1:40:12,28\t./.:.:.\n1\t20\tL2\tA\tC\t.\t.\t.\tGT:DP:AD\t0/1:40:18\t1|1:7:.\n2\t5\tL3\tA\tC\t.\t.\t.\tGT:RO:AO\t0/0/1/1:9:3,4\tbad\n"
    with gzip.open(tmp_path / "g.vcf.gz", "wt") as f:
        f.write(text)
    got = rows(R.read_genotypes(spark, str(tmp_path)))
    assert got == [("S1", "1_10", 0.5, 12.0, 28.0), ("S1", "L2", 0.5, 22.0, 18.0), ("S1", "L3", 0.5, 9.0, 7.0), ("S2", "1_10", None, None, None), ("S2", "L2", 1.0, 0.0, 7.0), ("S2", "L3", None, None, None)]


def test_sequences_trees_and_matrices(spark, tmp_path, rows):
    (tmp_path / "s.fa").write_text(">a first\nacg\nT\n>b\nGG\n")
    assert rows(R.read_fasta(spark, str(tmp_path / "s.fa"))) == [("a first", "a", "ACGT"), ("b", "b", "GG")]
    (tmp_path / "r.fq").write_text("@x 1\nACGT\n+\nIIII\n@y\nTT\n+\nII\n@cut\n")
    assert rows(R.read_fastq(spark, str(tmp_path / "r.fq"))) == [("r.fq", "x", "ACGT", "IIII"), ("r.fq", "y", "TT", "II")]
    (tmp_path / "t.nwk").write_text("((a:1,'b c':2.5)x:3,d);")
    tree = rows(R.read_newick(spark, str(tmp_path / "t.nwk")).select("node", "parent", "label", "length"))
    assert tree == [(0, None, None, None), (1, 0, "x", 3.0), (2, 1, "a", 1.0), (3, 1, "b c", 2.5), (4, 0, "d", None)]
    np.save(tmp_path / "m.npy", np.arange(6).reshape(2, 3))
    assert rows(R.read_npy(spark, str(tmp_path / "m.npy"))) == [("m.npy", [2, 3], [0.0, 1.0, 2.0, 3.0, 4.0, 5.0])]
    (tmp_path / "c.csv").write_text("x,y\n1,2\n3.5,-4\n")
    assert rows(R.read_contours(spark, str(tmp_path / "c.csv"))) == [("c.csv", [[1.0, 2.0], [3.5, -4.0]])]
    kinds = {r["path"].rsplit("/", 1)[1]: r["kind"] for r in R.classify_files(spark, str(tmp_path)).collect()}
    assert kinds == {"s.fa": "sequences", "r.fq": "reads", "t.nwk": "tree", "m.npy": "matrix", "c.csv": "table"}


def test_alignments():
    fasta = R.parse_alignment(">a\nAC\nG\n>b\nACT\n")
    assert fasta == [("a", "ACG"), ("b", "ACT")] == R.parse_alignment("2 3\na ACG\nb ACT\n")
    assert R.parse_alignment("2 6\na ACG\nb ACT\n\nTTT\nGGG\n") == [("a", "ACGTTT"), ("b", "ACTGGG")]
    assert R.parse_alignment("#NEXUS\nbegin data;\nmatrix\na AC\nb GT\n;\nend;") == [("a", "AC"), ("b", "GT")]
    assert R.parse_alignment("") == []


def test_json_pages_and_dosage(spark, tmp_path, rows):
    (tmp_path / "p.json").write_text('{"results": [{"key": 1, "name": "a"}, {"key": 2}]}')
    assert rows(R.read_occurrence_pages(spark, str(tmp_path / "p.json"), "key int, name string")) == [(1, "a"), (2, None)]
    (tmp_path / "d.csv").write_text("id,l1,l2\ns1,0,1\ns2,NA,2\n")
    assert rows(R.read_dosage_table(spark, str(tmp_path / "d.csv"))) == [("s1", "l1", 0.0), ("s1", "l2", 1.0), ("s2", "l1", None), ("s2", "l2", 2.0)]


def test_writers(spark, tmp_path, rows):
    at = str(tmp_path / "runs")
    W.write_run(spark.createDataFrame([("a", 1), ("b", 2)], "run string, v int"), at, "run")
    W.write_run(spark.createDataFrame([("b", 3)], "run string, v int"), at, "run")
    assert rows(spark.read.parquet(at).select("run", "v")) == [("a", 1), ("b", 3)]
    assert rows(W.completed_keys(spark, at, "run")) == [("a",), ("b",)] and rows(W.completed_keys(spark, at + "x", "run")) == []
    pts = spark.range(500).select((F.rand(1) * 80).alias("lat"), (F.rand(2) * 80).alias("lon"))
    W.write_clustered(pts, str(tmp_path / "pts"), "lat", "lon", 8)
    assert spark.read.parquet(str(tmp_path / "pts")).count() == 500
    W.write_single_csv(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "one"))
    assert len(list((tmp_path / "one").glob("*.csv"))) == 1


def test_field_sheets_with_other_headings(spark, tmp_path, rows):
    (tmp_path / "a.csv").write_text("Sample_ID, Collector ,Latitude,longitude,lat_lon\ns1,A. Gray,40.5,-110,\ns2,NA,x,y,\"41, -111\"\n")
    (tmp_path / "b.tsv").write_text("genetic_sample_id\trecordedBy\nnone\tB\n")
    (tmp_path / "c.csv").write_text("nothing,known\n1,2\n")
    (tmp_path / "d.csv").write_text("")
    df = R.read_field_sheets(spark, str(tmp_path))
    assert rows(df.select("file", "sample", "collector", "lat", "lon")) == [("a.csv", "s1", "A. Gray", 40.5, -110.0), ("a.csv", "s2", None, 41.0, -111.0), ("b.tsv", None, "B", None, None)]
    other = spark.createDataFrame([("s1", "H. Gray", None), ("s9", "x", 1.0)], "sample string, collector string, lat double")
    assert rows(R.with_overrides(df.filter("file = 'a.csv'").select("sample", "collector", "lat"), other, "sample")) == [("s1", "H. Gray", 40.5), ("s2", None, 41.0)]
