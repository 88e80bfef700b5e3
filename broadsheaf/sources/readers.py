"""Sources and sinks: batch archives, curated and imported Parquet, work lists, gazetteers, JSON lines, layouts."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_PAGE = 2 << 20

CURATED = "doc_id string, page_key string, lccn string, date date, year smallint, month tinyint, edition smallint, seq smallint, front_page boolean, batch string, batch_version smallint, ocr_source string, text_status string, text string, text_chars int, word_count int, text_sha256 binary, resource_url string, ingested_at timestamp"
OVERLAY = "doc_id string, page_key string, lccn string, date date, edition smallint, seq smallint, batch string, ocr_source string, ocr_engine string, loc_text string, text_status string, text string, text_chars int, text_sha256 binary, image_url string, ocred_at timestamp"
BATCHES = "name string, url string, sha256 string, ocr_source string"
LAYOUT = "array<struct<x:double,y:double,w:double,h:double,lines:array<struct<words:array<struct<text:string,x:double,y:double,w:double,h:double,conf:double>>>>>>"

#: Two layouts of a page's place in an archive.
DEEP = r"([^/]+)/(\d{4})/(\d{2})/(\d{2})/ed-(\d+)/seq-(\d+)/"
FLAT = r"([^/]+)/(\d{4}-\d{2}-\d{2})/ed-(\d+)/seq-(\d+)/"


def page_key(path):
    """lccn, date, edition and seq of a path in either layout; nulls where it is no page."""
    deep, flat = path.rlike(DEEP), path.rlike(FLAT)
    g = lambda p, i: F.regexp_extract(path, p, i)
    return F.when(flat | deep, F.struct(
        F.when(deep, g(DEEP, 1)).otherwise(g(FLAT, 1)).alias("lccn"),
        F.when(deep, F.try_to_date(F.concat_ws("-", g(DEEP, 2), g(DEEP, 3), g(DEEP, 4)))).otherwise(F.try_to_date(g(FLAT, 2))).alias("date"),
        F.when(deep, g(DEEP, 5)).otherwise(g(FLAT, 3)).try_cast("smallint").alias("edition"), F.when(deep, g(DEEP, 6)).otherwise(g(FLAT, 4)).try_cast("smallint").alias("seq"),
    ))


def archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file of tar archives (plain, gzip, bzip2, xz or zstd), with the page it is of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, raw in zip(pdf["path"], pdf["content"]):
                stream: io.BufferedIOBase = io.BytesIO(raw)
                if raw[:4] == b"\x28\xb5\x2f\xfd":
                    import zstandard

                    stream = zstandard.ZstdDecompressor().stream_reader(stream)
                    mode = "r|"
                else:
                    mode = "r|*"
                with tarfile.open(fileobj=stream, mode=mode) as tar:
                    for m in tar:
                        if m.isfile() and m.name.endswith("ocr.txt"):
                            data = tar.extractfile(m).read(MAX_PAGE + 1)
                            yield pd.DataFrame([(where, m.name, data[:MAX_PAGE].decode("utf-8", "replace"), len(data) > MAX_PAGE)], columns=["archive", "name", "text", "cut"])

    read = spark.read.format("binaryFile").load(path).select("path", "content")
    return read.mapInPandas(run, "archive string, name string, text string, cut boolean").withColumn("key", page_key(F.col("name"))).where("key.date is not null")


def batch_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BATCHES).option("multiLine", True).json(path)


def curated(spark: SparkSession, path: str, with_text: bool = True) -> DataFrame:
    """Curated pages by their fixed schema; without text the column is never read."""
    df = spark.read.schema(CURATED).parquet(path)
    return df if with_text else df.drop("text")


def write_curated(df: DataFrame, path: str, rows_per_file: int = 20_000) -> None:
    df.select(*(c.split()[0] for c in CURATED.split(", "))).write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").mode("append").parquet(path)


def overlay(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OVERLAY).parquet(path)


def checked_overlay(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of untrusted parts that hold together, and the others with the reason."""
    why = (
        F.when(F.col("doc_id").isNull() | (F.col("doc_id") == ""), "no id").when((F.col("text_status") == "ok") & F.col("text").isNull(), "text missing").when((F.col("text_status") != "ok") & F.col("text").isNotNull(), "text not ok")
        .when(F.length("text") != F.col("text_chars"), "length").when(F.octet_length("text") > MAX_PAGE, "too long").when(F.col("text_sha256").isNotNull() & (F.hex("text_sha256") != F.upper(F.sha2("text", 256))), "digest")
    )
    told = df.withColumn("why", why)
    return told.where("why is null").drop("why"), told.where("why is not null")


def visible_years(parts: DataFrame, finished: DataFrame) -> DataFrame:
    """Only parts of years with a completion marker."""
    return parts.join(finished.select("year").distinct(), "year", "left_semi")


def pictures(df: DataFrame) -> DataFrame:
    """Loosely typed picture rows to one schema; boxes that are not four numbers become null and are told."""
    box = F.transform(F.col("box").cast("array<string>"), lambda x: x.try_cast("double"))
    good = (F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull())
    return df.withColumn("box", F.when(good, box)).withColumn("score", F.col("score").try_cast("double")).withColumn("bad", ~F.coalesce(good, F.lit(False)))


def gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Places of state, name, lat, lon within range; of equal normalised names the first counts."""
    raw = spark.read.schema("state string, name string, lat double, lon double").option("header", True).csv(path)
    ok = raw.where(F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).withColumn("key", place_name(F.col("name")))
    return ok.groupBy("state", "key").agg(F.min_by(F.struct("name", "lat", "lon"), F.struct("name", "lat", "lon")).alias("p"), F.count("*").alias("n")).select("state", "key", "p.*", "n")


def place_name(name):
    """A place's key: folded, signs gone, saint and mount spelt out."""
    from ..functions.text import folded

    out = F.trim(F.regexp_replace(folded(name), r"[^a-z0-9]+", " "))
    return F.regexp_replace(F.regexp_replace(out, r"^st ", "saint "), r"^mt ", "mount ")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def quality_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("nullValue", "").csv(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON line per page document."""
    df.write.mode("errorifexists").json(path)


def write_by_decade(df: DataFrame, path: str) -> None:
    df.repartition("decade").sortWithinPartitions("decade", "day").write.mode("errorifexists").partitionBy("decade").parquet(path)


def to_kafka(df: DataFrame, servers: str, topic: str, key: str) -> None:
    """Partitioned by key; needs the Kafka connector on the classpath."""
    df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value")).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()




def alto(xml: str) -> list[dict]:
    """Blocks, lines and words of an ALTO layout, whatever its namespace."""
    import xml.etree.ElementTree as E

    try:
        root = E.fromstring(xml)
    except E.ParseError:
        return []
    plain = lambda e: e.tag.rpartition("}")[2]
    num = lambda e, k: float(e.get(k)) if e.get(k) else None
    box = lambda e: {"x": num(e, "HPOS"), "y": num(e, "VPOS"), "w": num(e, "WIDTH"), "h": num(e, "HEIGHT")}
    out = []
    for b in root.iter():
        if plain(b) == "TextBlock":
            lines = [{"words": [{"text": w.get("CONTENT"), **box(w), "conf": num(w, "WC")} for w in line if plain(w) == "String"]} for line in b if plain(line) == "TextLine"]
            out.append({**box(b), "lines": lines})
    return out


def layouts(df: DataFrame, xml_col: str) -> DataFrame:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: alto(x) if x else [])

    return df.withColumn("blocks", F.pandas_udf(run, LAYOUT)(xml_col))


def layout_words(df: DataFrame, id_col: str) -> DataFrame:
    """One row per word of a layout, in order."""
    b = df.select(id_col, F.posexplode("blocks").alias("block", "b"))
    line = b.select(id_col, "block", F.posexplode("b.lines").alias("line", "l"))
    return line.select(id_col, "block", "line", F.posexplode("l.words").alias("word", "w")).select(id_col, "block", "line", "word", "w.*")


def layout_stats(df: DataFrame, id_col: str, below: float = 0.5) -> DataFrame:
    """Blocks, lines, words, mean line height and word confidence of each page."""
    w = layout_words(df, id_col)
    return w.groupBy(id_col).agg(F.count_distinct("block").alias("blocks"), F.count_distinct("block", "line").alias("lines"), F.count("*").alias("words"), F.avg("h").alias("height"), F.avg("conf").alias("wc_mean"), F.median("conf").alias("wc_median"), F.avg((F.col("conf") < below).cast("int")).alias("wc_below"))


def to_alto(blocks: list[dict]) -> str:
    """An ALTO 4 document of a layout."""
    from xml.sax.saxutils import quoteattr as q

    at = lambda d: "".join(f" {k}={q(str(d[n]))}" for k, n in (("HPOS", "x"), ("VPOS", "y"), ("WIDTH", "w"), ("HEIGHT", "h")) if d.get(n) is not None)
    out = ['<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Layout><Page><PrintSpace>']
    for b in blocks:
        out.append(f"<TextBlock{at(b)}>")
        for line in b["lines"]:
            words = "".join(f"<String CONTENT={q(w['text'])}{at(w)}" + (f" WC={q(str(w['conf']))}" if w.get("conf") is not None else "") + "/>" for w in line["words"])
            out.append(f"<TextLine>{words}</TextLine>")
        out.append("</TextBlock>")
    return "".join([*out, "</PrintSpace></Page></Layout></alto>"])


def boxes(json_col, width, height):
    """Engine boxes (JSON of text and corners) clamped to the page."""
    parsed = F.from_json(json_col, "array<struct<text:string,x0:double,y0:double,x1:double,y1:double>>")

    def clamp(b):
        x0, y0 = F.greatest(F.least(b["x0"], b["x1"]), F.lit(0.0)), F.greatest(F.least(b["y0"], b["y1"]), F.lit(0.0))
        x1, y1 = F.least(F.greatest(b["x0"], b["x1"]), width), F.least(F.greatest(b["y0"], b["y1"]), height)
        return F.struct(b["text"].alias("text"), x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))

    return F.filter(F.transform(parsed, clamp), lambda b: (b["w"] > 0) & (b["h"] > 0))
