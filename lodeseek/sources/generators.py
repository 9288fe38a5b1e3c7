"""Deterministic note corpora of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Topics of the scale corpus (title, folder, tags, text).
TOPICS = (
    ("Coordination map", "Projects/Search", ("research", "search"), "Reducing coordination overhead needs explicit ownership handoff, consensus, and a durable decision record. Release planning links each decision to its evidence."),
    ("Garden plan", "Home/Garden", ("home", "reference"), "Garden soil, irrigation, native flowers, and seasonal planting make a practical home reference for spring maintenance."),
    ("Budget review", "Finance/Planning", ("finance", "planning"), "A fictional monthly budget compares recurring costs, savings targets, and a calm review cadence without personal account details."),
    ("Travel research", "Travel/Research", ("travel", "research"), "A fictional rail itinerary collects museum hours, neighborhood walks, and flexible reservations for later travel research."),
    ("Kitchen reference", "Kitchen/Recipes", ("recipes", "reference"), "A pantry recipe reference explains ingredient substitutions, preparation order, and a simple weeknight cooking schedule."),
    ("Incident review", "Operations/Incidents", ("operations", "reliability"), "The fictional failure review records detection, response, recovery, and follow-up ownership before the next release."),
    ("Architecture record", "Architecture/Records", ("systems", "research"), "This decision record compares queue boundaries, failure isolation, and service ownership for a fictional distributed system."),
    ("Reading notes", "Reading/Notes", ("reading", "reference"), "Fictional reading notes summarize public themes, questions, and references without quoting a real book or author."),
    ("Wellness plan", "Health/Plans", ("health", "planning"), "A fictional wellness plan tracks walking, rest, hydration, and gradual habits without private medical information."),
    ("Weekly meeting", "Meetings/Weekly", ("meeting", "work"), "A fictional weekly meeting note lists an agenda, open questions, next actions, and a clear owner for every follow-up."),
)
# Sentences that tell the notes of the scale corpus apart.
DRAFT, REVIEWED = "Status draft.", "Status reviewed."
SPLIT, ROUTINE = "The fictional appendix mentions a split brain scenario.", "The fictional appendix records a routine scenario."


def scale_notes(spark: SparkSession, count: int) -> DataFrame:
    """``count`` notes over ten topics, with the number ``seq`` of each from 1."""
    i, topic = F.col("id"), F.get(F.array(*[F.struct(F.lit(t).alias("title"), F.lit(f).alias("folder"), F.array(*map(F.lit, g)).alias("tags"), F.lit(x).alias("text")) for t, f, g, x in TOPICS]), (F.col("id") % len(TOPICS)).cast("int"))
    created = F.unix_millis(F.make_timestamp((2023 + i % 4).cast("int"), (1 + i % 12).cast("int"), (1 + i % 23).cast("int"), F.lit(12), F.lit(0), F.lit(0), F.lit("UTC")))
    rows = spark.range(count).select((i + 1).alias("seq"), "id", topic.alias("t"), created.alias("ctime"))
    rows = rows.withColumn("basename", F.concat(F.col("t.title"), F.lit(" "), F.lpad(F.col("seq").cast("string"), F.greatest(F.lit(5), F.length(F.col("seq").cast("string"))), F.lit("0"))))
    content = F.concat_ws(
        "\n\n", F.concat(F.lit("# "), F.col("basename")), F.col("t.text"), F.when(i % 7 == 0, DRAFT).otherwise(REVIEWED), F.when(i % 11 == 0, SPLIT).otherwise(ROUTINE),
        F.concat(F.lit("Synthetic scale document "), F.col("seq").cast("string"), F.lit(".")),
    )
    return rows.select(
        "seq", F.concat(F.col("t.folder"), F.lit("/"), F.col("basename"), F.lit(".md")).alias("path"), "basename", F.lit("md").alias("extension"), content.alias("content"), F.col("t.tags").alias("tags"),
        "ctime", (F.col("ctime") + (i % 120) * 86_400_000).alias("mtime"),
    ).withColumn("size", F.char_length("content").cast("bigint"))


def cycled_vault(spark: SparkSession, corpus: DataFrame, count: int = 1000) -> DataFrame:
    """``count`` notes that go through ``corpus`` again and again, with front matter tags and numbered names; the corpus must fit a broadcast."""
    from pyspark.sql import Window

    numbered = corpus.withColumn("_n", F.row_number().over(Window.orderBy("path")) - 1)
    size = numbered.agg(F.count(F.lit(1)).alias("_all"))
    turns = spark.range(count).crossJoin(F.broadcast(size)).withColumn("_n", (F.col("id") % F.col("_all")).cast("int"))
    front = F.concat(F.lit("---\ntags: ["), F.array_join("tags", ", "), F.lit("]\n---\n\n"))
    name = F.concat(F.col("basename"), F.lit(" "), F.lpad((F.col("id") + 1).cast("string"), 4, "0"))
    return turns.join(F.broadcast(numbered), "_n").select(F.concat(F.lit("Lab/"), name, F.lit(".md")).alias("path"), name.alias("basename"), "extension", F.concat(front, "content").alias("content"), "tags", "ctime", "mtime").withColumn("size", F.octet_length("content").cast("bigint"))
