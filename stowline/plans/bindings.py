"""The operator tables (catalog, requests, records, metrics, fleet, …) as views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowline.sources.inventory import spread


class Tables:
    """Lazily opened parquet tables of one data folder; ``wide_<name>`` is spread over all cores."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("wide_"):
            df = spread(getattr(self, name.removeprefix("wide_")))
            setattr(self, name, df)
            return df
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        setattr(self, name, df)
        return df


def _kind() -> Column:
    return F.lower("p_type")


def _base() -> Column:
    by_size = F.element_at(
        F.array(*[F.lit(x) for x in ("fa", "fa.fai", "gff", "vcf.gz", "bed")]), (F.col("p_size") % 5 + 1).cast("int"))
    return F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("."), by_size)


def _folder() -> Column:
    return F.concat_ws("/", _kind(), "p_brand")


def _path() -> Column:
    return F.concat_ws("/", _kind(), "p_brand", _base())


def _k(mod: int) -> Column:
    return F.col("p_partkey") % mod


def parts(t: Tables) -> DataFrame:
    """Part rows with the pieces the other bindings are made of, over all cores: what is made of them costs more than the scan."""
    return t.wide_part.select(
        F.col("p_partkey").alias("k"), _kind().alias("kind"), F.col("p_brand").alias("brand"),
        _base().alias("base"), _folder().alias("folder"), _path().alias("path"),
        F.col("p_size").cast("long").alias("psize"), F.col("p_name").alias("pname"),
    )


def catalog(t: Tables) -> DataFrame:
    """``(ord, uri, size)``: an object-store listing with repeated names."""
    return t.wide_part.select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit("gs://b"), _k(3).cast("string"), F.lit("/"), _path()).alias("uri"),
        (F.col("p_size").cast("long") * 1048576).alias("size"),
    )


def objects(t: Tables) -> DataFrame:
    """``(ord, container, file_id, path)``: the same listing with ids split off."""
    return t.wide_part.select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit("b"), _k(3).cast("string")).alias("container"),
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_id"),
        _path().alias("path"),
    )


def keyed_listing(t: Tables) -> DataFrame:
    """``(ord, project, file_id, path)`` before the last-wins merge."""
    return t.wide_part.select(
        F.col("p_partkey").alias("ord"),
        F.concat(F.lit("p"), _k(2).cast("string")).alias("project"),
        F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("file_id"),
        F.concat(F.lit("/"), _path()).alias("path"),
    )


def requests(t: Tables) -> DataFrame:
    """``(req_id, names)``: two names joined by ``;``, the second often a glob."""
    p = parts(t)
    ext = F.expr("substr(base, instr(base, '.') + 1)")
    last_word = F.substring_index("pname", " ", -1)
    first = F.when(F.col("k") % 21 == 0, F.col("base")).otherwise(F.concat_ws("/", "brand", "base"))
    turn = (F.floor(F.col("k") / 7) % 4).cast("int")
    second = (
        F.when(turn == 0, F.concat("folder", F.lit("/*_"), last_word, F.lit("."), ext))
        .when(turn == 1, F.concat(F.lit("*"), "folder", F.lit("/"), "base"))
        .when(turn == 2, F.replace("base", F.lit("_"), F.lit("?")))
        .otherwise(F.concat("brand", F.lit("/[a-l]*."), ext))
    )
    return p.select(F.col("k").alias("req_id"), F.concat_ws(";", first, second).alias("names"))


def listing(t: Tables) -> DataFrame:
    """``(path)``: files found under local base folders."""
    base = F.element_at(
        F.array(*[F.lit(x) for x in ("/data/ref", "/data/in0", "/data/in1", "/data/ref")]), (_k(4) + 1).cast("int"))
    return t.wide_part.select(F.concat_ws("/", base, _path()).alias("path")).distinct()


def bases() -> Column:
    return F.array(*[F.lit(x) for x in ("/data/ref", "/data/in0", "/data/in1")])
