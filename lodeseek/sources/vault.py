"""Markdown folders as a source of notes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _front(text: Column) -> Column:
    """The lines between a first line ``---`` and the next one; empty without them."""
    starts = F.startswith(text, F.lit("---\n"))
    end = F.when(starts, F.position(F.lit("\n---"), text, F.lit(4))).otherwise(0)
    return F.when(end > 0, F.substring(text, F.lit(5), end - 4)).otherwise(F.lit(""))


def listed_tags(front: Column) -> Column:
    """Tags of front matter: ``tags: [a, b]``, ``tags: a, b`` or a block list of ``- a`` lines."""
    inline = F.split(F.regexp_replace(F.regexp_extract(front, r"(?m)^tags:[ \t]*(\S.*)$", 1), r"[\[\]]", ""), ",")
    block = F.regexp_extract_all(F.regexp_extract(front, r"(?m)^tags:[ \t]*\n((?:[ \t]*-[ \t]+.*(?:\n|$))+)", 1), F.lit(r"(?m)^[ \t]*-[ \t]+(.*)$"), F.lit(1))
    return F.filter(F.transform(F.concat(inline, block), lambda t: F.regexp_replace(F.trim(t), "^[\"']|[\"']$", "")), lambda t: t != "")


def read_vault(spark: SparkSession, root: str) -> DataFrame:
    """Notes of all Markdown files under ``root``.

    Tags are the front matter's list and the inline ``#tags``; files have no
    creation time here, so ctime is mtime.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(re.sub(r"([\[\]{}*?\\])", r"\\\1", root))
    base = root.removeprefix("file://").rstrip("/") + "/"
    text = F.decode("content", "UTF-8")
    whole = F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B")))
    relative = F.substring(whole, F.position(F.lit(base), whole) + len(base), F.char_length(whole))
    front = _front(text)
    listed = listed_tags(front)
    own = F.when(front != "", F.substring(text, F.char_length(front) + 9, F.char_length(text))).otherwise(text)
    inline = F.regexp_extract_all(own, F.lit(r"(?:^|\s)#([\p{L}\p{N}_/-]*[\p{L}_][\p{L}\p{N}_/-]*)"), F.lit(1))
    millis = F.unix_millis("modificationTime")
    return files.select(
        relative.alias("path"), F.regexp_extract(relative, r"([^/]*)\.md$", 1).alias("basename"), F.lit("md").alias("extension"), text.alias("content"),
        F.array_distinct(F.concat(listed, inline)).alias("tags"), millis.alias("ctime"), millis.alias("mtime"), F.col("length").alias("size"),
    )


def read_corpus(spark: SparkSession, catalog: str, root: str) -> DataFrame:
    """Notes of a JSON catalog (file, path, ctime, mtime dates, tags) with bodies in files under ``root``."""
    listed = spark.read.option("multiLine", "true").schema("file string, path string, ctime string, mtime string, tags array<string>").json(catalog)
    bodies = read_vault(spark, root).select(F.col("path").alias("file"), "content", "size")
    millis = lambda c: F.unix_millis(F.to_timestamp(c))
    return listed.join(bodies, "file").select("path", F.regexp_extract("path", r"([^/]*)\.md$", 1).alias("basename"), F.lit("md").alias("extension"), "content", "tags", millis("ctime").alias("ctime"), millis("mtime").alias("mtime"), "size")
