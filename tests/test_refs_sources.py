"""Reference bundles, inventories and file sources."""

import json

import pytest
from pyspark.sql import functions as F

from stowline.functions import paths as P
from stowline.operators import refs as RF
from stowline.plans import lifecycle as LC
from stowline.sources import files as SF
from stowline.sources import inventory as I


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def catalog(spark, *uris):
    return spark.createDataFrame(list(enumerate(uris)), "ord long, uri string")


def bundle(spark, uris, build="hg19", aligner="bwa"):
    builds = spark.createDataFrame([(build, aligner, "r/" + build)], "build string, aligner string, prefix string")
    listed = catalog(spark, *uris)
    members = rows(RF.reference_bundle(builds, listed), "key", "role", "uri")
    forms = {r["kind"]: r["form"] for r in RF.reference_status(builds, listed).collect()}
    return members, forms


def test_base_and_indexes(spark):
    members, forms = bundle(spark, ["r/hg19/seq/hg19.fa", "r/hg19/seq/hg19.fa.fai", "r/hg19/rtg/one", "r/hg19/bwa/a", "r/hg19/bwa/b"])
    assert members == [("bwa", "index", "r/hg19/bwa/a"), ("bwa", "index", "r/hg19/bwa/b"), ("fasta", "base", "r/hg19/seq/hg19.fa"),
                       ("fasta", "index", "r/hg19/seq/hg19.fa.fai"), ("rtg", "plain", "r/hg19/rtg/one")]
    assert forms == {"seq": "base", "rtg": "single", "bwa": "indexes"}


def test_tarballs_win(spark):
    members, forms = bundle(spark, ["r/hg19/bwa-x-wf.tar.gz", "r/hg19/bwa/a", "r/hg19/rtg--v1-wf.tar.gz", "r/hg19/rtg/mainIndex"])
    assert members == [("bwa", "base", "r/hg19/bwa-x-wf.tar.gz"), ("bwa", "index", "r/hg19/bwa-x-wf.tar.gz"),
                       ("rtg", "plain", "r/hg19/rtg--v1-wf.tar.gz")]
    assert forms == {"seq": "indexes", "rtg": "tarball", "bwa": "tarball base"}


def test_violations_have_no_members(spark):
    members, forms = bundle(spark, ["r/hg19/seq/hg19.fa", "r/hg19/seq/mainIndex", "r/hg19/rtg-1-wf.tar.gz", "r/hg19/rtg-2-wf.tar.gz"])
    assert members == [] and forms == {"seq": "too many bases", "rtg": "too many tarballs", "bwa": "indexes"}


def test_prefix_has_no_boundary(spark):
    members, _ = bundle(spark, ["r/hg19/seq/hg19.fa", "r/hg19/sequences/x"], aligner="")
    assert members == [("fasta", "base", "r/hg19/seq/hg19.fa"), ("fasta", "index", "r/hg19/sequences/x")]


def base(spark, *extra):
    return spark.createDataFrame([("hg19", "s3://b/hg19/seq", "db1")], "build string, base_dir string, db string")


def test_viral_database_context(spark):
    listed = catalog(
        spark, "s3://b/hg19/viral/z.fai", "s3://b/hg19/viral/v.fa", "s3://b/hg19/viral/w.fa", "s3://b/hg19/snpeff/db1/snpEffectPredictor.bin",
        "s3://b/hg19/snpeff/db1/x.bin", "s3://b/hg19/snpeff/db10/y.bin", "s3://b/hg19/coverage/problem_regions/q/b.bed.gz",
        "s3://b/hg19/coverage/problem_regions/a.bed.gz", "s3://b/hg19/coverage/problem_regions/c.bed", "s3://b/hg19/versions.csv")
    assert rows(RF.viral_bundle(base(spark), listed), "role", "uri") == [
        ("base", "s3://b/hg19/viral/v.fa"), ("index", "s3://b/hg19/viral/z.fai")]
    assert rows(RF.database_bundle(base(spark), listed), "role", "uri") == [
        ("base", "s3://b/hg19/snpeff/db1/snpEffectPredictor.bin"), ("index", "s3://b/hg19/snpeff/db1/x.bin")]
    assert [r["name"] for r in RF.context_files(base(spark), listed).orderBy("name", "ord").collect()] == ["a.bed.gz", "b.bed.gz"]
    assert rows(RF.companion(base(spark), listed, RF.versions_path()), "uri") == [("s3://b/hg19/versions.csv",)]
    assert rows(RF.companion(base(spark), listed, F.lit("no")), "uri") == [(None,)]
    only_index = catalog(spark, "s3://b/hg19/viral/z.fai", "s3://b/hg19/snpeff--db1-wf.tar.gz", "s3://b/hg19/snpeff/db1/x.bin")
    assert rows(RF.viral_bundle(base(spark), only_index), "role") == [("no base",)]
    assert rows(RF.database_bundle(base(spark), only_index), "role", "uri") == [("plain", "s3://b/hg19/snpeff--db1-wf.tar.gz")]


def test_relative_resources(spark):
    listed = catalog(spark, "s3://b/hg19/var/d.vcf.gz", "s3://b/hg19/var/d.vcf.gz", "s3://b/other/var/e.vcf.gz")
    res = spark.createDataFrame(
        [(1, "s3://b/hg19/seq", "v", "d", "../var/d.vcf.gz"), (2, "s3://b/hg19/seq", "v", "e", "../../other/var/e.vcf.gz"),
         (3, "s3://b/hg19/seq", "v", "g", "../var/gone"), (4, "s3://b/hg19/seq", "a", "x", "plain"), (5, "s3://b/hg19/seq", "a", "n", None)],
        "res_id long, base_dir string, k1 string, k2 string, value string")
    assert rows(RF.resolve_relative(res, listed), "res_id", "value") == [(1, "s3://b/hg19/var/d.vcf.gz"), (4, "plain"), (5, None)]
    looked = rows(RF.resolve_relative(res, listed, lookup=True), "res_id", "value")
    assert looked == [(1, "s3://b/hg19/var/d.vcf.gz")] * 2 + [(2, "s3://b/other/var/e.vcf.gz"), (4, "plain"), (5, None)]


def test_jars(spark):
    sheets = spark.createDataFrame([(1, "s3://b/p/s.yaml")], "sheet_id long, uri string")
    listed = catalog(spark, "s3://b/p/jars/MuTect-1.jar", "s3://b/jars/MuTect-9.jar", "s3://b/jars/GenomeAnalysisTK-mutect.jar",
                     "s3://b/jars/GenomeAnalysisTK-2.jar", "s3://b/jars/other.jar")
    assert rows(RF.jar_resources(sheets, listed), "program", "uri") == [
        ("gatk", "s3://b/jars/GenomeAnalysisTK-2.jar"), ("mutect", "s3://b/p/jars/MuTect-1.jar")]


def test_genome_references(spark):
    builds = spark.createDataFrame([("mm10", "bwa")], "build string, aligner string")
    listed = catalog(spark, "gs://r/genomes/mm10/seq/mm10.fa", "gs://r/genomes/mm10/bwa/mm10.fa.bwt")
    assert rows(LC.genome_references(builds, listed, "gs://r"), "key", "role") == [("bwa", "plain"), ("fasta", "base")]


def test_listing_text(spark):
    lines = spark.createDataFrame([("gs://b/dir/:",), ("",), ("  ",), ("gs://b/dir/x ",)], "value string")
    assert rows(I.parse_listing(lines)) == [("gs://b/dir/x",)]


def test_folder_tree(spark):
    nodes = spark.createDataFrame(
        [(1, 0, "a", "folder"), (2, 1, "b", "folder"), (3, 2, "x.bam", "file"), (4, 1, "y.bam", "file"), (5, 0, "z.bam", "file"),
         (6, 9, "far.bam", "file")], "id long, parent long, name string, type string")
    assert rows(I.expand_folders(nodes, 0)) == [(3, "a/b/x.bam"), (4, "a/y.bam"), (5, "z.bam")]
    start = I.find_folder(nodes, 0, "a/b").first()["id"]
    assert start == 2 and rows(I.expand_folders(nodes, start)) == [(3, "x.bam")]


def test_ordered_listing(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",)], "path string")
    assert rows(I.ordered_listing(df), "ord", "path") == [(0, "a"), (1, "b"), (2, "c")]


def test_prefix_listing(spark):
    listed = catalog(spark, "b/x", "b/xy", "c/x")
    assert rows(I.under_prefix(listed, "b/x"), "uri") == [("b/x",), ("b/xy",)]
    objects = spark.createDataFrame([(0, "p", "f0", "/d/x"), (1, "q", "f1", "/d/y")], "ord long, project string, file_id string, path string")
    prefixes = spark.createDataFrame([("dx:any/p:/d",)], "prefix string")
    assert rows(I.under_object_prefix(objects, prefixes, "dx"), "uri") == [("dx:f0/p:/d/x",)]
    prefixes = spark.createDataFrame([("sbg:any//d/y",)], "prefix string")
    assert rows(I.under_object_prefix(objects, prefixes, "sbg"), "uri") == [("sbg:f1//d/y",)]


@pytest.mark.parametrize("ext", ["json", "yaml"])
def test_sheet_and_resource_files(spark, tmp_path, ext):
    if ext == "yaml" and SF.yaml is None:
        pytest.skip("no YAML reader here")
    sheet = {"fc_name": "f", "upload": {"dir": "../final"}, "details": [{"files": ["a.bam"], "lane": 1}, {"files": "b.bam"}]}
    (tmp_path / f"s.{ext}").write_text(json.dumps(sheet))
    got = SF.sheet_samples(SF.read_documents(spark, str(tmp_path))).orderBy("pos").collect()
    assert [json.loads(r["sample"]) for r in got] == sheet["details"]
    assert json.loads(got[0]["sheet"])["fc_name"] == "f" and "details" not in json.loads(got[0]["sheet"])
    values = SF.resource_values(spark.createDataFrame([("p", '{"version":"1","aliases":{"snpeff":"db"},"rnaseq":{"t":"../x"}}')],
                                                      "path string, json string"))
    assert rows(values, "k1", "k2", "value") == [("aliases", "snpeff", "db"), ("rnaseq", "t", "../x")]


def test_location_table(spark, tmp_path):
    folder = tmp_path / "cfg" / "tool-data"
    folder.mkdir(parents=True)
    (folder / "sam.loc").write_text("#c\nindex\thg19\t/old/seq/hg19.fa\nindex mm10 ../genomes/mm10/seq/mm10.fa\nindex hg19 ../genomes/hg19/seq/hg19.fa\n"
                                    "index abs /abs/seq/x.fa\n")
    got = rows(SF.genome_folders(SF.read_lines(spark, str(folder))), "folder")
    assert got == [(str(tmp_path / "cfg" / "genomes"),)]


def test_file_scan_and_sinks(spark, tmp_path):
    (tmp_path / "raw" / "h1").mkdir(parents=True)
    (tmp_path / "raw" / "h1" / "a.raw.gz").write_bytes(b"12345")
    got = SF.scan_raw_metrics(spark, str(tmp_path / "raw"))
    assert rows(got, "host", "name", "size") == [("h1", "a.raw.gz", 5)]
    schema = got._jdf.queryExecution().executedPlan().toString().split("ReadSchema: ")[1].split("\n")[0]
    assert "content" not in schema
    records = spark.createDataFrame([('{"a":1}',)], "json string")
    SF.write_records(records, str(tmp_path / "out"))
    assert rows(spark.read.json(str(tmp_path / "out"))) == [(1,)]
    assert SF.ready_path("/x/s.yaml") == "/x/s-ready.yaml"
    lines = spark.createDataFrame([("h", "12 1700000000 /var/a.raw.gz"), ("h", " ")], "host string, value string")
    assert rows(SF.parse_stat_lines(lines), "name", "size") == [("/var/a.raw.gz", 12)]


def test_resource_name(spark):
    df = spark.createDataFrame([("/r/hg19.fa",)], "f string")
    assert rows(df.select(RF.resource_file("f"), RF.gene_bed_path(F.lit("/r/t.gtf.gz")), P.extension("f"))) == [
        ("/r/hg19-resources.yaml", "/r/t.bed", ".fa")]
