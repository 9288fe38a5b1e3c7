"""One consistent form for texts that look the same.

Texts are exploded to positioned code points, joined with a broadcast mapping
(decompositions, width forms, blanks, invisible characters and look-alike
letters), their combining marks are put into canonical order, recomposed, and
the strings are rebuilt. Rows are partitioned by text before they are exploded,
so code points never cross the network.

The mapping is made by rule from Unicode's data: decompositions from Python's
database, letters of the same shape from the confusables that come with Spark's
collation library. It has fewer rows than Unicode has code points, which bounds the broadcast.

Folded: canonical decompositions, full-width and half-width forms, blanks of
any width, ligatures and other signs that stand for several letters, invisible
format characters, variation selectors, CR and CR LF line ends, Roman numerals, and
letters of any script with the shape of a Latin letter of their case. Kept apart, as a reader sees
them: case, accents, punctuation, raised and lowered digits, styled letters.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodeseek.operators.skew import hot_keys, salted_join
from lodeseek.runtime import materialize, shuffle_partitions

# Letters of the same shape as a Latin one that the rule below does not give, or gives otherwise.
LOOKALIKES = "ҺH ԚQ ӏl"

Alike = tuple[tuple[int, int], ...]


@lru_cache(maxsize=1)
def _from_unicode(skeletons) -> Alike:
    """Cased letters without a decomposition that share the skeleton of exactly one Latin letter of their case.

    Skeletons are those of Unicode's confusables, asked for all letters in one text.
    """
    latin = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B))]
    letters = [c for c in map(chr, range(0x80, sys.maxunicode + 1)) if unicodedata.category(c) in ("Lu", "Ll") and not unicodedata.decomposition(c)]
    shapes = skeletons("\n".join(latin + letters)).split("\n")
    by_shape: dict[tuple, list[str]] = {}
    for c, shape in zip(latin, shapes):
        by_shape.setdefault((shape, c.isupper()), []).append(c)
    found = {c: same[0] for c, shape in zip(letters, shapes[len(latin) :]) if len(same := by_shape.get((shape, c.isupper()), [])) == 1}
    found.update(LOOKALIKES.split())
    return tuple(sorted((ord(a), ord(b)) for a, b in found.items()))


def lookalikes(spark: SparkSession) -> Alike:
    """(letter, Latin letter of the same shape), from the confusables data that comes with Spark's collation library."""
    return _from_unicode(_skeletons(spark))


@lru_cache(maxsize=1)
def _skeletons(spark: SparkSession):
    return spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton


_L, _V, _T = range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)


@lru_cache(maxsize=2)
def mapping(alike: Alike = ()) -> dict[int, tuple[int, ...]]:
    """Code point -> the code points it becomes, for every code point that changes; ``alike`` adds letters of the same shape."""
    shapes = dict(alike)
    tagged = {"<wide>", "<narrow>", "<noBreak>"}
    raw: dict[int, tuple[int, ...]] = {}
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category == "Cs":
            continue
        if category == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            raw[cp] = ()
        elif category == "Zs":
            raw[cp] = (0x20,)
        elif cp in shapes:
            raw[cp] = (shapes[cp],)
        elif parts := unicodedata.decomposition(ch).split():
            tag = parts.pop(0) if parts[0][0] == "<" else ""
            to = tuple(int(x, 16) for x in parts)
            letters = tag == "<compat>" and len(to) > 1 and all(unicodedata.category(chr(x))[0] == "L" for x in to)
            single = tag == "<compat>" and len(to) == 1 and (category in ("Nl", "Lo") or cp == 0xB5)  # Roman numerals, letters used as signs
            if not tag or tag in tagged or letters or single or (tag == "<compat>" and 0x2F00 <= cp <= 0x2FDF):
                raw[cp] = to
        elif 0xAC00 <= cp <= 0xD7A3:
            raw[cp] = tuple(map(ord, unicodedata.normalize("NFD", ch)))

    def whole(cp: int) -> tuple[int, ...]:
        return tuple(y for x in raw[cp] for y in (whole(x) if x in raw and x != cp else (x,))) if cp in raw else (cp,)

    return {cp: whole(cp) for cp in raw if raw[cp] != (cp,)}


@lru_cache(maxsize=1)
def compositions() -> dict[str, tuple[str, str]]:
    """Mark -> (starters it composes with, their composites), without the ones Unicode excludes."""
    pairs: dict[str, tuple[str, str]] = {}
    for cp in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(cp)).split()
        if len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            starters, made = pairs.get(mark := chr(int(parts[1], 16)), ("", ""))
            pairs[mark] = starters + chr(int(parts[0], 16)), made + chr(cp)
    return pairs


@lru_cache(maxsize=2)
def touched(alike: Alike = ()) -> str:
    """All characters whose presence can change a text.

    A precomposed letter that decomposes and recomposes to itself is none of
    them: it can change only before a mark, and marks are in the list.
    """
    known = mapping(alike)

    def stable(cp: int) -> bool:
        to = "".join(map(chr, known[cp]))
        return unicodedata.normalize("NFC", to) == chr(cp) and unicodedata.normalize("NFD", chr(cp)) == to

    marks = {cp for cp in range(sys.maxunicode + 1) if unicodedata.category(chr(cp))[0] == "M"}
    return "".join(map(chr, sorted(({cp for cp in known if not stable(cp)} | marks | {0x0D, *_V, *_T}) - {0x20})))


def _table(spark: SparkSession) -> DataFrame:
    """(_ch, _to array<struct<c, k>>): the mapping, and each combining mark by itself; k is the combining class."""
    rows = dict(mapping(lookalikes(spark)))
    for cp in range(sys.maxunicode + 1):
        if unicodedata.combining(chr(cp)) and cp not in rows:
            rows[cp] = (cp,)
    data = [(chr(cp), [(chr(c), unicodedata.combining(chr(c))) for c in to]) for cp, to in rows.items()]
    return spark.createDataFrame(data, "_ch string, _to array<struct<c:string,k:int>>")


def _compose(units: Column) -> Column:
    """The string of one cluster: array<struct<k, .., c>> of a starter and its marks in canonical order."""
    start = F.struct(units[0]["c"].alias("s"), F.lit("").alias("rest"), F.lit(0).alias("last"))
    marks = list(compositions())  # found by their place in short constant strings
    starters, composites = (F.array(*[F.lit(compositions()[m][i]) for m in marks]) for i in (0, 1))
    char = lambda cp: F.decode(F.unhex(F.lpad(F.hex(cp), 4, "0")), "UTF-16BE")

    def add(state: Column, mark: Column) -> Column:
        s, c = state["s"], mark["c"]
        a, b = F.ascii(s), F.ascii(c)
        syllable = F.when(a.between(_L[0], _L[-1]) & b.between(_V[0], _V[-1]), char(F.lit(0xAC00) + ((a - _L[0]) * 21 + (b - _V[0])) * 28)).when(
            a.between(0xAC00, 0xD7A3) & ((a - 0xAC00) % 28 == 0) & b.between(_T[0], _T[-1]), char(a + (b - (_T[0] - 1)))
        )
        free = (state["rest"] == "") | ((state["last"] < mark["k"]) & (state["last"] > 0))
        at = F.instr(F.lit("".join(marks)), c)
        place = F.instr(F.get(starters, at - 1), s)
        made = F.when(free, F.coalesce(syllable, F.when((at > 0) & (place > 0), F.substring(F.get(composites, at - 1), place, F.lit(1)))))
        bound = F.transform(F.array(made), lambda m: F.struct(
            F.coalesce(m, s).alias("s"),
            F.when(m.isNull(), F.concat(state["rest"], c)).otherwise(state["rest"]).alias("rest"),
            F.when(m.isNull(), mark["k"]).otherwise(state["last"]).alias("last"),
        ))
        return bound[0]

    done = F.aggregate(F.slice(units, F.lit(2), F.size(units) - 1), start, add, lambda x: F.concat(x["s"], x["rest"]))
    return F.when(F.size(units) == 1, units[0]["c"]).otherwise(done)


def consistent(texts: DataFrame, key: list[str], text: str, out: str) -> DataFrame:
    """(key, text, out): ``out`` is the consistent form of ``text``.

    ``key`` must be unique and not null. Null stays null and empty stays empty. Texts without
    any character that could change are their own form and are not exploded; a
    text is rebuilt in the task that holds it, whatever its length.
    """
    rows = texts.select(*key, text)
    spark = texts.sparkSession
    hard = F.coalesce(F.translate(text, touched(lookalikes(spark)), "") != F.col(text), F.lit(False))
    plain = rows.filter(~hard).withColumn(out, F.col(text))
    exploded = rows.filter(hard).repartition(shuffle_partitions(spark), *key)  # many times as large once it is exploded
    chars = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "")
    points = exploded.select(*key, F.posexplode(chars).alias("_pos", "_ch")).filter("_ch <> ''")
    mapped = points.join(F.broadcast(_table(spark)), "_ch", "left")
    to = F.coalesce("_to", F.array(F.struct(F.col("_ch").alias("c"), F.lit(0).alias("k"))))
    units = mapped.select(*key, "_pos", F.posexplode(to).alias("_sub", "_u")).select(*key, "_pos", "_sub", F.col("_u.c").alias("c"), F.col("_u.k").alias("k"))
    order = Window.partitionBy(*key).orderBy("_pos", "_sub")
    code, before = F.ascii("c"), F.ascii(F.lag("c").over(order))
    jamo = (code.between(_V[0], _V[-1]) & before.between(_L[0], _L[-1])) | (code.between(_T[0], _T[-1]) & before.between(_V[0], _V[-1]))
    starts = units.withColumn("_start", ((F.col("k") == 0) & ~F.coalesce(jamo, F.lit(False))).cast("int"))
    clusters = starts.withColumn("_cluster", F.sum("_start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    by_cluster = clusters.groupBy(*key, "_cluster").agg(F.array_sort(F.collect_list(F.struct("k", "_pos", "_sub", "c"))).alias("_units"))
    built = by_cluster.select(*key, "_cluster", _compose(F.col("_units")).alias("_s")).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_cluster", "_s"))).alias("_all"))
    joined = F.coalesce(F.array_join(F.transform("_all", lambda x: x["_s"]), ""), F.lit(""))
    return plain.unionByName(exploded.join(built, key, "left").select(*key, text, joined.alias(out)))


def same_looking_classes(texts: DataFrame, item: str, field: str, value: str) -> DataFrame:
    """(item, field, class, spelling) of the items whose value looks like another one that differs in characters.

    ``texts`` has one row per (item, field). Null and empty values never count.
    A class is all values of a field that look the same, a spelling all of the
    class with the same characters; both are 128-bit hashes. Two items of a class
    are a pair of ``same_looking_pairs`` when their spellings differ.
    """
    items, several, _ = _classes(texts, item, field, value)
    return items.join(several, ["_f", "_form"], "left_semi").select(F.col("_id").alias(item), F.col("_f").alias(field), F.col("_form").alias("class"), F.col("_raw").alias("spelling"))


def _classes(texts: DataFrame, item: str, field: str, value: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    filled = texts.filter(F.col(value).isNotNull() & (F.col(value) != "") & F.col(item).isNotNull()).select(F.col(item).alias("_id"), F.col(field).alias("_f"), F.col(value).alias("_v"))
    formed = consistent(filled, ["_id", "_f"], "_v", "_c").filter("_c <> ''")
    items = materialize(formed.select("_id", "_f", F.md5("_c").alias("_form"), F.md5("_v").alias("_raw")), "forms")
    spellings = items.groupBy("_f", "_form", "_raw").agg(F.count(F.lit(1)).alias("_n"))
    several = spellings.groupBy("_f", "_form").agg(F.count(F.lit(1)).alias("_k")).filter("_k > 1").select("_f", "_form")
    return items, several, spellings


def same_looking_pairs(texts: DataFrame, item: str, field: str, value: str) -> DataFrame:
    """Pairs of items (a < b) whose value of a field looks the same but is not the same sequence of characters.

    ``texts`` has one row per (item, field). Null and empty values never count.
    The different spellings of a form are paired once and then filled with their
    items; a spelling that very many items share is cut by item, so it is not one task's.
    """
    items, several, spellings = _classes(texts, item, field, value)
    spellings = spellings.join(several, ["_f", "_form"], "left_semi")
    a, b = (spellings.select("_f", "_form", F.col("_raw").alias(f"_raw_{x}")) for x in "ab")
    pairs = a.join(b, ["_f", "_form"]).filter("_raw_a < _raw_b")
    for x in "ab":
        key = ["_f", "_form", f"_raw_{x}"]
        members = items.join(several, ["_f", "_form"], "left_semi").select("_f", "_form", F.col("_raw").alias(f"_raw_{x}"), F.col("_id").alias(f"_id_{x}"))
        pairs = salted_join(members, pairs, key, hot_keys(spellings.withColumnRenamed("_raw", f"_raw_{x}"), key, "_n"), [f"_id_{x}"])
    return pairs.select(F.least("_id_a", "_id_b").alias(f"{item}_a"), F.greatest("_id_a", "_id_b").alias(f"{item}_b"), F.col("_f").alias(field))
