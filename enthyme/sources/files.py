"""Files of a corpus: what there is, what can't be read, chapters, bundles, marked-up documents as lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How well a kind of file keeps its text, by extension.
TIERS = {"md": "gold", "markdown": "gold", "docx": "silver", "epub": "silver", "html": "silver", "htm": "silver", "odt": "silver", "rtf": "silver", "tex": "silver", "pdf": "bronze", "txt": "plain", "text": "plain"}


def tier(path: Column) -> Column:
    """gold, silver, bronze or plain; null for a kind that is not read."""
    return F.create_map(*[F.lit(x) for kv in TIERS.items() for x in kv])[F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))]


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, tier, skipped) of all files below a folder, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    hidden = F.regexp_like("path", F.lit(r"/[._][^/]*(/|$)|/node_modules/"))
    return files.select("path", "length", tier(F.col("path")).alias("tier"), (hidden | tier(F.col("path")).isNull()).alias("skipped"))


def texts(spark: SparkSession, path: str, glob: str = "*.md") -> DataFrame:
    """(path, text), one row a file."""
    return spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def chapters(books: DataFrame, key: str = "path", text: str = "text", level: int = 1) -> DataFrame:
    """(path, chapter, title, text): a Markdown book cut at headings of a level; what stands before the first is chapter 0."""
    lines = books.select(F.col(key).alias("path"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("i", "raw"))
    head = F.regexp_like("raw", F.lit(f"^#{{{level}}} "))
    lines = lines.withColumn("chapter", F.sum(head.cast("int")).over(Window.partitionBy("path").orderBy("i")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "raw"))), lambda x: x["raw"]), "\n")
    title = F.min(F.when(head, F.trim(F.regexp_replace("raw", "^#+", ""))))
    return lines.groupBy("path", "chapter").agg(title.alias("title"), whole.alias("text"))


MARK = "%% attached: "


def attach(maps: DataFrame, sources: DataFrame) -> DataFrame:
    """(map_id, bundle): a map with its sources behind it, in order; attaching again replaces what was attached. maps(map_id, text),
    sources(map_id, name, ord, text)."""
    parts = sources.groupBy("map_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name", "text"))), lambda x: F.concat(F.lit("\n" + MARK), x["name"], F.lit(" "), F.length(x["text"]), F.lit("\n"), x["text"])), "").alias("parts"))
    bare = F.split_part("text", F.lit("\n" + MARK), F.lit(1))
    return maps.join(parts, "map_id", "left").select("map_id", F.concat(bare, F.coalesce("parts", F.lit(""))).alias("bundle"))


def detach(bundles: DataFrame) -> DataFrame:
    """(map_id, name, text, whole): the map (name null) and each attached source; whole is false if the bundle was cut short."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, bundle in zip(f["map_id"], f["bundle"], strict=True):
                head, *_ = (bundle or "").split("\n" + MARK, 1)
                out.append((k, None, head, True))
                at = len(head)
                while m := re.compile(re.escape("\n" + MARK) + r"(.*) (\d+)\n").match(bundle or "", at):
                    text = bundle[m.end() : m.end() + int(m[2])]
                    out.append((k, m[1], text, len(text) == int(m[2])))
                    at = m.end() + int(m[2])
            yield pd.DataFrame(out, columns=["map_id", "name", "text", "whole"])

    return bundles.select("map_id", "bundle").mapInPandas(run, "map_id string, name string, text string, whole boolean")


def marked_up(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(path, line, kind, text) of TEI and JATS documents: headings by depth, paragraphs, notes; kind `fault` if the XML can't be read."""

    def plain(e: ElementTree.Element) -> str:
        return " ".join("".join(e.itertext()).split())

    def walk(e: ElementTree.Element, depth: int) -> Iterator[tuple[str, str]]:
        for child in e:
            name = child.tag.rsplit("}", 1)[-1] if isinstance(child.tag, str) else ""
            if name in ("head", "title"):
                yield f"h{min(6, max(1, depth))}", plain(child)
            elif name in ("p", "ab"):
                yield "p", plain(child)
            elif name in ("note", "fn"):
                yield "note", plain(child)
            elif name in ("div", "sec", "body", "text", "group", "back", "front", "fn-group", "abstract", "article-meta", "title-group"):
                yield from walk(child, depth + (name in ("div", "sec")))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, xml in zip(f["path"], f["text"], strict=True):
                try:
                    found = list(walk(ElementTree.fromstring(xml or ""), 0))
                except ElementTree.ParseError as e:
                    found = [("fault", str(e))]
                out += [(k, i + 1, kind, t) for i, (kind, t) in enumerate(found)]
            yield pd.DataFrame(out, columns=["path", "line", "kind", "text"])

    return files.select(F.col(key).cast("string").alias("path"), F.col(text).alias("text")).mapInPandas(run, "path string, line int, kind string, text string")
