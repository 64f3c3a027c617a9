"""Files written and read again; a stream against a batch."""

from datetime import datetime, timedelta

from seriesloom.sources import files
from seriesloom.streaming.counts import count_stream


def test_text_sources(spark, tmp_path):
    (tmp_path / "x.bed").write_text("chr1\t0\t10\t.\t0\t.\nchr2\t5\t9\nbad\n")
    assert [(r.chrom, r.start, r.end) for r in files.read_bed(spark, str(tmp_path / "x.bed")).collect()] == [("chr1", 1, 10), ("chr2", 6, 9)]
    (tmp_path / "p.tsv").write_text("chromosome\tstart\tlength\n1\t100\t-50\n1\tNA\t5\n2\t7\t3\n")
    assert [(r.start, r.end, r.file) for r in files.read_positions(spark, str(tmp_path / "p.tsv")).collect()] == [(100, 149, "p.tsv"), (7, 9, "p.tsv")]
    (tmp_path / "UID_1.flagstat").write_text("\n".join(f"{100 + i} + 0 line" for i in range(1, 14)))
    (tmp_path / "short.flagstat").write_text("7 + 0 total\n")
    got = {r.name: r for r in files.read_flagstat(spark, str(tmp_path / "*.flagstat")).collect()}
    assert (got["UID_1"].qctotal, got["UID_1"].qcmatemappedmapq5, got["short"].qctotal, got["short"].qcmapped) == (101.0, 113.0, 7.0, None)
    (tmp_path / "g.gff").write_text("#c\n1\ts\tgene\t5\t9\t.\t+\t.\tID=a;Name=b\n1\ts\texon\t5\t9\t.\t+\t.\tID=c\n")
    assert [r.Name for r in files.read_gff_attributes(spark, str(tmp_path / "g.gff"), "gene", "Name").collect()] == ["b"]


def test_parquet_and_exports(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "i int, s string").write.parquet(str(tmp_path / "a"))
    spark.createDataFrame([(2, 3.0)], "i int, t double").write.parquet(str(tmp_path / "b"))
    assert sorted((r.i, r.s, r.t) for r in files.read_cohort(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).collect()) == [(1, "a", None), (2, None, 3.0)]
    spark.createDataFrame([("hg19", 500, "1"), ("hg38", 500, "2")], "genome string, bin_kb int, chrom string").write.partitionBy("genome", "bin_kb").parquet(str(tmp_path / "bins"))
    b = files.read_bins(spark, str(tmp_path / "bins"), "hg19", 500)
    assert [r.chrom for r in b.collect()] == ["1"] and "PartitionFilters: [isnotnull(genome" in b._jdf.queryExecution().executedPlan().toString()
    df = spark.createDataFrame([("1", 1, 2, None, 1.5, "c"), ("1", 3, 4, 2, None, "c")], "chr string, start int, end int, state int, copy double, cell_id string")
    files.write_signals(df, str(tmp_path / "s"))
    assert {r[0] for r in spark.read.text(str(tmp_path / "s")).collect()} == {"chr,start,end,state,copy,cell_id", "1,1,2,,1.5,c", "1,3,4,2,,c"}
    files.write_wide(df, "cell_id", ["start"], "state", str(tmp_path / "w"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "w")).collect()] == ["c,,2"]


def test_stream_counts_equal_batch(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [(t + timedelta(minutes=7 * i), i % 50 + 1, "k") for i in range(60)]
    spark.createDataFrame(rows, "at timestamp, pos int, k string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, pos int, k string").parquet(str(tmp_path / "in"))
    q = count_stream(stream, "at", "pos", ["k"], 10).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    got = sorted((r.start, r.bin, r.n) for r in spark.table("counts").collect())
    want = sorted((r.start, r.bin, r.n) for r in count_stream(spark.createDataFrame(rows, "at timestamp, pos int, k string"), "at", "pos", ["k"], 10).collect())
    assert got == want and sum(n for _, _, n in got) == 60
