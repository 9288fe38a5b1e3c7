"""The queries over text corpora and their SQL."""

from __future__ import annotations

import unicodedata

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodeseek.llm.elite import distinctive_terms, typical_terms
from lodeseek.llm.fusion import best_by_every_score, fuse_ranks
from lodeseek.llm.lookalike import consistent, lookalikes, mapping, same_looking_classes, same_looking_pairs
from lodeseek.llm.markup import clean_markup
from lodeseek.llm.mixing import mix
from lodeseek.llm.neighbours import VectorIndex
from lodeseek.llm.ngrams import marked_values, suffix_counts, tag_lists
from lodeseek.llm.packing import pack, too_large
from lodeseek.llm.quality import quality
from lodeseek.llm.records import current_records
from lodeseek.llm.sizes import token_sizes, word_count
from lodeseek.runtime import materialize, spread, table


def _sizes(spark, sf):
    docs = table(spark, sf, "documents")
    return materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")


def p1_found(spark, sf):
    return best_by_every_score(fuse_ranks(table(spark, sf, "search_results"), position=False)).select("query_id", "path")


def p1_ranking(spark, sf):
    return fuse_ranks(table(spark, sf, "search_results")).withColumn("fused", F.round("fused", 9))


def p2_found(spark, sf):
    return clean_markup(table(spark, sf, "notes"), ["note_id"]).select("note_id", F.explode("kinds").alias("markup"))


def p2_clean(spark, sf):
    return clean_markup(table(spark, sf, "notes"), ["note_id"])


def _plain_notes(spark, sf):
    """Notes that hold no sign of markup: letters, digits and usual punctuation, lines without blanks around them or doubled."""
    whole = F.col("content").rlike(_PLAIN) & ~F.col("content").rlike(_UNEVEN)
    return table(spark, sf, "notes").filter(whole)


def p2_plain(spark, sf):
    """What has no markup comes out as it is."""
    return clean_markup(_plain_notes(spark, sf), ["note_id"]).select("note_id", F.size("kinds").cast("bigint").alias("kinds"), "clean_text")


def p2_furniture(spark, sf):
    """Plain notes inside a page with navigation, links and a footer: what is left is the note."""
    page = F.concat(F.lit(_ABOVE), F.regexp_replace("content", "\n", "<br>\n"), F.lit(_BELOW))
    pages = _plain_notes(spark, sf).withColumn("content", page)
    return clean_markup(pages, ["note_id"]).select("note_id", F.regexp_replace("clean_text", r"\n+", "\n").alias("clean_text"))


_PLAIN = r"^[\p{L}\p{N},;:.?! \n]*[\p{L}\p{N}][\p{L}\p{N},;:.?! \n]*$"
_UNEVEN = r"(?m)[ ]{2}|^[ ]|[ ]$|^[0-9A-Za-z][.)]|^[0-9]+[.)]|\n\n\n|\n\z|\A\n"
_ABOVE = '<html><body><nav><ul><li><a href="/">Home</a></li><li><a href="/about">About</a></li></ul> | Login</nav>\n<a href="/a">One</a><br>\n<a href="/b">Two</a><br>\n<a href="/c">Three</a>\n<p>'
_BELOW = "</p>\n<footer>Copyright 2026 / <a href='/privacy'>Privacy</a> / Terms</footer></body></html>"


def _note_fields(spark, sf):
    """(note_id, field, value): content and basename of each note; note ids are unique."""
    notes = table(spark, sf, "notes").select("note_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("content", "basename")])).alias("e"))
    return notes.select("note_id", "e.field", "e.value")


def p3_found(spark, sf):
    return same_looking_pairs(_note_fields(spark, sf), "note_id", "field", "value")


def p3_forms(spark, sf):
    return consistent(_note_fields(spark, sf), ["note_id", "field"], "value", "form")


def p3_classes(spark, sf):
    return same_looking_classes(_note_fields(spark, sf), "note_id", "field", "value")


def p4_found(spark, sf):
    return typical_terms(distinctive_terms(table(spark, sf, "lexical_docs"))).select("path", "term")


def p4_scores(spark, sf):
    return distinctive_terms(table(spark, sf, "lexical_docs"))


def p4_counts(spark, sf):
    """What goes into the mixture: frequencies, records holding a term, and all records."""
    return distinctive_terms(table(spark, sf, "lexical_docs")).select("path", "term", "tf", "token_count", "df", "records")


def p5_found(spark, sf):
    return VectorIndex(table(spark, sf, "note_vectors")).similar_pairs(0.9).select("vec_id_a", "vec_id_b")


def p5_nearest(spark, sf):
    vectors = table(spark, sf, "note_vectors")
    return VectorIndex(vectors, probes=12).nearest(vectors.filter("vec_id % 20 = 0"), 10)


def p5_exact(spark, sf):
    """The same without abandoning what may still be near."""
    vectors = table(spark, sf, "note_vectors")
    return VectorIndex(vectors, epsilon=None).nearest(vectors.filter("vec_id % 20 = 0"), 10).withColumn("cosine", F.round("cosine", 6))


def p5_links(spark, sf):
    return VectorIndex(table(spark, sf, "note_vectors"), epsilon=None).links(0.9).select("rep_a", "rep_b", F.round("cosine", 6).alias("cosine"))


def p5_classes(spark, sf):
    return VectorIndex(table(spark, sf, "note_vectors")).classes


def p7_found(spark, sf):
    return marked_values(current_records(table(spark, sf, "lexical_docs"))).filter("mark is not null").select("field", "value", "mark")


def p7_counts(spark, sf):
    return marked_values(current_records(table(spark, sf, "lexical_docs")))


def p7_ngrams(spark, sf):
    return suffix_counts(current_records(table(spark, sf, "lexical_docs")), tag_lists(), 3)


def p8_found(spark, sf):
    return too_large(pack(_sizes(spark, sf), table(spark, sf, "pack_limits")))


def p8_containers(spark, sf):
    return pack(_sizes(spark, sf), table(spark, sf, "pack_limits"))


def p8_fills(spark, sf):
    """Per limit the items, their total, and the containers and items that break a rule."""
    limits = table(spark, sf, "pack_limits")
    packed = p8_containers(spark, sf).join(F.broadcast(limits.select("limit_name", "capacity").distinct()), "limit_name")
    bins = packed.filter("container IS NOT NULL").groupBy("limit_name", "container").agg(F.sum("piece_size").alias("content"), F.max("fill").alias("fill"), F.min("length").alias("length"), F.max("capacity").alias("capacity"))
    bad = bins.groupBy("limit_name").agg(F.count_if((F.col("content") != F.col("fill")) | (F.col("fill") > F.col("length")) | (F.col("length") > F.col("capacity"))).alias("wrong_containers"))
    items = packed.groupBy("limit_name").agg(
        F.count(F.lit(1)).alias("pieces"), F.sum("piece_size").alias("total"),
        F.count_if((F.col("pieces") > 1) & (F.col("piece") < F.col("pieces") - 1) & (F.col("piece_size") != F.col("capacity"))).alias("wrong_pieces"),
    )
    return items.join(bad, "limit_name", "left").fillna(0)


def p8_tokens(spark, sf):
    """The containers for sizes in tokens of a public vocabulary."""
    import public_tokenizers

    sizes = token_sizes(spread(table(spark, sf, "documents").select("doc_id", "text")), public_tokenizers.path(VOCABULARY), ["doc_id"])
    return pack(materialize(sizes, "sizes"), table(spark, sf, "pack_limits"))


def p9_found(spark, sf):
    return mix(_sizes(spark, sf), table(spark, sf, "mix_targets"))[1].filter(~F.col("fills")).select("source")


def p9_shares(spark, sf):
    return mix(_sizes(spark, sf), table(spark, sf, "mix_targets"))[1]


def p9_plan(spark, sf):
    """The plan, and whether the size reached is within one document of what is due."""
    sizes = _sizes(spark, sf)
    report = mix(sizes, table(spark, sf, "mix_targets"))[1]
    largest = sizes.groupBy("source").agg(F.max("size").alias("largest"))
    due = F.least(F.col("target_size"), (F.col("max_repeats") * F.col("size")).cast("double"))
    near = F.abs(F.col("reached_size") - due) <= F.coalesce("largest", F.lit(0))
    return report.join(F.broadcast(largest), "source", "left").select("source", "documents", "size", "max_repeats", F.round("target_share", 6).alias("target_share"), F.round("target_size", 3).alias("target_size"), F.round("copies", 6).alias("copies"), "fills", near.alias("near"))


def p9_caps(spark, sf):
    """Documents drawn more often than allowed, or of no listed source: none."""
    drawn, report = mix(_sizes(spark, sf), table(spark, sf, "mix_targets"))
    both = drawn.join(F.broadcast(report.select("source", "max_repeats")), "source", "left")
    return both.agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("too_often"), F.count_if(F.col("max_repeats").isNull()).alias("unlisted"), F.count_if(F.col("copies") < 1).alias("never"))


def p9_mix(spark, sf):
    return mix(_sizes(spark, sf), table(spark, sf, "mix_targets"))[0]


def p10_found(spark, sf):
    return p10_statistics(spark, sf).filter(F.col("verdict") != "prose").select("doc_id", F.col("verdict").alias("kind"))


def p10_statistics(spark, sf):
    return quality(table(spark, sf, "documents"), table(spark, sf, "quality_labels"), table(spark, sf, "common_words"))


def p10_counts(spark, sf):
    """The statistics that SQL can take."""
    return p10_statistics(spark, sf).select("doc_id", "words", *[F.round(c, 6).alias(c) for c in ("word_length", "letter_share", "digit_share")])


VOCABULARY = "byte_bpe_50k.tiktoken"


def queries():
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


_RECORDS = """r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST) AS rn FROM lexical_docs WHERE path IS NOT NULL) WHERE rn = 1)"""
_TERMS = """e AS (SELECT path, token_count, unnest(map_entries(term_frequency)) AS x FROM r),
t AS (SELECT path, token_count, lower(x.key) AS term, sum(x.value)::BIGINT AS tf FROM e WHERE x.value >= 1 AND x.key <> '' GROUP BY ALL)"""
_TAGS = """g AS (SELECT path, regexp_replace(lower(tag), '^#', '') AS tag FROM (SELECT path, unnest(tags) AS tag FROM r))"""
_VALUES = f"""WITH {_RECORDS}, {_TERMS}, {_TAGS},
n AS (SELECT count(*) AS n FROM r),
v AS (SELECT 'term' AS field, term AS value, sum(tf)::BIGINT AS total, count(DISTINCT path)::BIGINT AS records FROM t GROUP BY term
UNION ALL SELECT 'tag', tag, count(*)::BIGINT, count(DISTINCT path)::BIGINT FROM g WHERE tag <> '' GROUP BY tag),
m AS (SELECT field, value, total, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.3 * n THEN 'common' END AS mark FROM v, n)"""
_RANKS = """WITH c AS (SELECT query_id, path,
 max(CASE WHEN lower(lexical_score::VARCHAR) <> 'nan' THEN lexical_score END) AS lexical_score,
 max(CASE WHEN lower(semantic_score::VARCHAR) <> 'nan' THEN semantic_score END) AS semantic_score,
 max(CASE WHEN lower(score::VARCHAR) <> 'nan' THEN score END) AS score FROM search_results WHERE query_id IS NOT NULL AND path IS NOT NULL GROUP BY ALL),
k AS (SELECT query_id, path,
 CASE WHEN lexical_score IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY lexical_score DESC NULLS LAST) END AS lexical_score_rank,
 CASE WHEN semantic_score IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY semantic_score DESC NULLS LAST) END AS semantic_score_rank,
 CASE WHEN score IS NOT NULL THEN rank() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST) END AS score_rank FROM c)"""
_PLAIN_SQL = f"regexp_matches(content, '{_PLAIN}') AND NOT regexp_matches(content, '{_UNEVEN}')"
_UNITS = """WITH u AS (SELECT vec_id, max({'p': provider_id, 'v': vector}) AS s FROM note_vectors WHERE provider_id IS NOT NULL AND len(vector) > 0
AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY vec_id),
w AS (SELECT vec_id, s.p AS p, s.v AS v, sqrt(list_inner_product(s.v, s.v)) AS n FROM u)"""
_SIZES = r"""s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+'))::BIGINT AS size FROM documents)"""


_TARGETS = f"""WITH {_SIZES}, w AS (SELECT source, sum(weight) AS weight, min(max_repeats) AS max_repeats FROM mix_targets WHERE source IS NOT NULL AND weight > 0 GROUP BY source),
z AS (SELECT w.*, (SELECT count(*) FROM s WHERE s.source = w.source) AS documents, coalesce((SELECT sum(size) FROM s WHERE s.source = w.source), 0)::BIGINT AS size FROM w)"""


def oracle_sql():
    sql = {
        "p1_found": _RANKS + " SELECT query_id, path FROM k WHERE lexical_score_rank <= 5 AND semantic_score_rank <= 5 AND score_rank <= 5",
        "p1_ranking": _RANKS + """, f AS (SELECT *, coalesce(1.0::DOUBLE / (60.0::DOUBLE + lexical_score_rank), 0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + semantic_score_rank), 0) + coalesce(1.0::DOUBLE / (60.0::DOUBLE + score_rank), 0) AS fused FROM k)
 SELECT query_id, path, lexical_score_rank, semantic_score_rank, score_rank, round(fused, 9) AS fused, rank() OVER (PARTITION BY query_id ORDER BY fused DESC) AS position FROM f""",
        "p2_plain": f"SELECT note_id, 0::BIGINT AS kinds, content AS clean_text FROM notes WHERE {_PLAIN_SQL}",
        "p2_furniture": f"SELECT note_id, regexp_replace(content, '\\n+', chr(10), 'g') AS clean_text FROM notes WHERE {_PLAIN_SQL}",
        "p4_found": f"WITH {_RECORDS}, {_TERMS}, d AS (SELECT term, count(*) AS df FROM t GROUP BY term) SELECT path, term FROM t JOIN d USING (term) WHERE df BETWEEN 2 AND 10 AND token_count > 0 AND tf * 20 >= token_count",
        "p4_counts": f"WITH {_RECORDS}, {_TERMS}, d AS (SELECT term, count(*) AS df FROM t GROUP BY term) SELECT path, term, tf, token_count, df, (SELECT count(*) FROM r) AS records FROM t JOIN d USING (term)",
        "p5_found": _UNITS + " SELECT a.vec_id AS vec_id_a, b.vec_id AS vec_id_b FROM w a JOIN w b ON a.p = b.p AND len(a.v) = len(b.v) AND a.vec_id < b.vec_id WHERE list_inner_product(a.v, b.v) >= 0.9 * a.n * b.n",
        "p5_exact": _UNITS + """, s AS (SELECT a.vec_id, b.vec_id AS neighbour, CASE WHEN a.v = b.v THEN 1 ELSE list_inner_product(a.v, b.v) / a.n / b.n END AS cosine FROM w a JOIN w b ON a.p = b.p AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(cosine, 12) DESC, neighbour) AS place FROM s) SELECT vec_id, neighbour, round(cosine, 6) AS cosine, place::INT AS place FROM t WHERE place <= 10""",
        "p5_links": _UNITS + """, c AS (SELECT p, v, any_value(n) AS n, min(vec_id) AS rep FROM w GROUP BY p, v) SELECT least(a.rep, b.rep) AS rep_a, greatest(a.rep, b.rep) AS rep_b, round(list_inner_product(a.v, b.v) / a.n / b.n, 6) AS cosine
FROM c a JOIN c b ON a.p = b.p AND len(a.v) = len(b.v) AND a.rep < b.rep WHERE list_inner_product(a.v, b.v) >= 0.9 * a.n * b.n""",
        "p5_classes": _UNITS + " SELECT min(vec_id) OVER (PARTITION BY p, v) AS rep, vec_id FROM w",
        "p7_found": _VALUES + " SELECT field, value, mark FROM m WHERE mark IS NOT NULL",
        "p7_counts": _VALUES + " SELECT * FROM m",
        "p7_ngrams": f"""WITH {_RECORDS}, g AS (SELECT path, list_filter(list_transform(tags, lambda t: regexp_replace(lower(t), '^#', '')), lambda t: t <> '') AS v FROM r),
 i AS (SELECT path, v, unnest(range(1, len(v) + 1)) AS i FROM g), x AS (SELECT path, v[i : i + n - 1] AS ngram FROM i, (SELECT unnest([1, 2, 3]) AS n) WHERE i + n - 1 <= len(v))
 SELECT ngram, count(*) AS total, count(DISTINCT path) AS records FROM x GROUP BY ngram""",
        "p8_fills": f"""WITH {_SIZES}, l AS (SELECT DISTINCT limit_name, capacity FROM pack_limits WHERE limit_name IS NOT NULL AND capacity > 0)
 SELECT limit_name, sum(greatest(1, ceil(size / capacity)))::BIGINT AS pieces, sum(size)::BIGINT AS total, 0::BIGINT AS wrong_containers, 0::BIGINT AS wrong_pieces FROM s, l GROUP BY limit_name""",
        "p8_found": f"WITH {_SIZES} SELECT DISTINCT limit_name, doc_id FROM s, pack_limits WHERE size > capacity",
        "p9_plan": _TARGETS + """, q AS (SELECT *, (SELECT sum(size) FROM z) * weight / (SELECT sum(weight) FROM z) AS due FROM z) SELECT source, documents, size, max_repeats, round(weight / (SELECT sum(weight) FROM z), 6) AS target_share, round(due, 3) AS target_size,
 round(CASE WHEN size > 0 THEN least(max_repeats, due / size) ELSE 0 END, 6)::DOUBLE AS copies, max_repeats * size >= due AS fills, true AS near FROM q""",
        "p9_caps": "SELECT 0::BIGINT AS too_often, 0::BIGINT AS unlisted, 0::BIGINT AS never",
        "p10_counts": r"""WITH c AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, len(regexp_extract_all(t, '[\p{L}\p{N}_]+'))::BIGINT AS words, length(regexp_replace(t, '[^\p{L}\p{N}_]', '', 'g')) AS w, length(regexp_replace(t, '[^\p{L}]', '', 'g')) AS l, length(regexp_replace(t, '[^\p{Nd}]', '', 'g')) AS d,
 greatest(1, length(regexp_replace(t, '[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]', '', 'g'))) AS dense FROM c)
 SELECT doc_id, words, round(w / greatest(words, 1), 6) AS word_length, round(l / dense, 6) AS letter_share, round(d / dense, 6) AS digit_share FROM n""",
        "p9_found": _TARGETS + """
SELECT source FROM z WHERE max_repeats * size < (SELECT sum(size) FROM z) * weight / (SELECT sum(weight) FROM z)""",
    }
    spark = SparkSession.getActiveSession()
    return sql | (_forms_sql(spark) if spark else {})


def _forms_sql(spark):
    """Consistent forms by replacement and normalization; the shapes of letters come from the session's library."""
    single, removed, several = [], [], []
    for cp, to in mapping(lookalikes(spark)).items():
        ch, made = chr(cp), unicodedata.normalize("NFC", "".join(map(chr, to)))
        if made == unicodedata.normalize("NFC", ch):
            continue
        (single if len(made) == 1 else several if made else removed).append((ch, made))
    source, target = "".join(a for a, _ in single + removed), "".join(b for _, b in single).replace("'", "''")
    form = "replace(replace(value, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    for ch, made in several:
        form = f"replace({form}, '{ch}', '{made}')"
    form = f"nfc_normalize(translate({form}, '{source}', '{target}'))"
    fields = f"v AS (SELECT note_id, 'content' AS field, content AS value FROM notes UNION ALL SELECT note_id, 'basename', basename FROM notes), f AS (SELECT note_id, field, value, {form} AS form FROM v)"
    several_forms = "c AS (SELECT field, form FROM f WHERE value <> '' AND form <> '' GROUP BY field, form HAVING count(DISTINCT value) > 1)"
    return {
        "p3_forms": f"WITH {fields} SELECT note_id, field, value, form FROM f",
        "p3_classes": f"WITH {fields}, {several_forms} SELECT note_id, field, md5(form) AS class, md5(value) AS spelling FROM f JOIN c USING (field, form) WHERE value <> ''",
        "p3_found": f"WITH {fields}, {several_forms}, m AS (SELECT f.* FROM f JOIN c USING (field, form) WHERE value <> '') SELECT a.note_id AS note_id_a, b.note_id AS note_id_b, a.field FROM m a JOIN m b ON a.field = b.field AND a.form = b.form AND a.note_id < b.note_id AND a.value <> b.value",
    }
