"""Queries compiled to Column expressions over an index's documents."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.functions.text import fuzzy_score, normalize_text
from lodeseek.plans.query import Filter, Query

# Fixed values of the ranking.
K1, B, BODY_WEIGHT, PREFIX_WEIGHT = 1.35, 0.7, 3.0, 0.65
NAME_EQUAL, NAME_PREFIX, NAME_PART, FUZZY_WEIGHT, FUZZY_LEAST = 22.0, 13.0, 9.0, 4.0, 0.62
PATH_PART, TAG_EQUAL, TAG_PART = 3.5, 8.0, 4.0
PHRASE_NAME, PHRASE_PATH, PHRASE_TAG, PHRASE_CONTENT = 20.0, 12.0, 10.0, 8.0
RECENCY_WEIGHT, RECENCY_DAYS, DAY = 0.08, 45.0, 86_400_000


def any_tag(test) -> Column:
    return F.exists("norm_tags", test)


def field_filter(f: Filter) -> Column:
    """Whether the field contains the value; an excluded filter inverts it."""
    found = {
        "path": lambda: F.col("norm_path").contains(f.value),
        "file": lambda: F.col("norm_name").contains(f.value),
        "tag": lambda: any_tag(lambda t: F.contains(t, F.lit(f.value))),
        "ext": lambda: F.col("norm_ext").contains(f.value),
    }[f.field]()
    return ~found if f.excluded else found


def date_filter(name: str, millis: int) -> Column:
    column = F.col("ctime" if name.startswith("created") else "mtime")
    return column >= millis if name.endswith("after") else column < millis


def has_term(term: str) -> Column:
    """An exact token of the document, or from three characters on the start of one."""
    return _token_in("tokens_all", term)


def _token_in(tokens: str, term: str) -> Column:
    exact = F.array_contains(tokens, term)
    return exact | F.exists(tokens, lambda t: t.startswith(term)) if len(term) >= 3 else exact


def has_phrase(phrase: str) -> Column:
    return F.concat_ws("\n", "norm_name", "norm_path", F.array_join("norm_tags", " "), "norm_content").contains(phrase)


class Whole:
    """Evidence from a document's own columns: its tokens, term map and body."""

    def term(self, term: str) -> Column:
        return has_term(term)

    def phrase(self, phrase: str) -> Column:
        return has_phrase(phrase)

    def content(self, phrase: str) -> Column:
        return F.contains("norm_content", F.lit(phrase))

    def exact(self, term: str) -> Column:
        return F.coalesce(F.try_element_at("tf", F.lit(term)), F.lit(0)).cast("double")

    def started(self, term: str) -> Column:
        return F.aggregate(F.map_values(F.map_filter("tf", lambda k, v: k.startswith(term))), F.lit(0).cast("bigint"), lambda a, x: a + x)


class Joined(Whole):
    """Evidence in columns that were joined to slim documents, made by ``hits`` and ``held``."""

    def __init__(self, terms: list[str], phrases: list[str]):
        self.terms, self.phrases = terms, phrases

    def hits(self, postings: DataFrame) -> DataFrame:
        """Per path the frequency of each term and of all terms it starts, from the terms' part of the postings."""
        reach = [F.col("term") == t if len(t) < 3 else F.col("term").startswith(t) for t in self.terms]
        sums = {f"_x{i}": F.sum(F.when(F.col("term") == t, F.col("tf"))) for i, t in enumerate(self.terms)}
        sums |= {f"_s{i}": F.sum(F.when(F.col("term").startswith(t), F.col("tf"))) for i, t in enumerate(self.terms) if len(t) >= 3}
        return postings.filter(reduce(or_, reach)).groupBy("path").agg(*[c.alias(n) for n, c in sums.items()])

    def held(self, bodies: DataFrame) -> DataFrame:
        """Per path which phrases its body holds; paths without any are left out."""
        flags = [F.contains("norm_content", F.lit(p)).alias(f"_h{i}") for i, p in enumerate(self.phrases)]
        return bodies.select("path", *flags).filter(reduce(or_, [F.col(f"_h{i}") for i in range(len(self.phrases))]))

    def term(self, term: str) -> Column:
        return (self.exact(term) > 0) | (self.started(term) > 0) | _token_in("tokens_meta", term)

    def phrase(self, phrase: str) -> Column:
        meta = F.concat_ws("\n", "norm_name", "norm_path", F.array_join("norm_tags", " ")).contains(phrase)
        return meta | self.content(phrase)

    def content(self, phrase: str) -> Column:
        return F.coalesce(F.col(f"_h{self.phrases.index(phrase)}"), F.lit(False))

    def exact(self, term: str) -> Column:
        return F.coalesce(F.col(f"_x{self.terms.index(term)}"), F.lit(0)).cast("double")

    def started(self, term: str) -> Column:
        return F.coalesce(F.col(f"_s{self.terms.index(term)}"), F.lit(0)) if len(term) >= 3 else F.lit(0)


WHOLE = Whole()


def hard_constraints(q: Query, by: Whole = WHOLE) -> Column:
    tests = [date_filter(k, v) for k, v in q.dates.items()] + [field_filter(f) for f in q.filters]
    tests += [by.phrase(p) for p in q.required_phrases] + [by.term(t) for t in q.required_terms]
    tests += [~by.phrase(p) for p in q.excluded_phrases] + [~by.term(t) for t in q.excluded_terms]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def result_filters(folder: str | None = None, tag: str | None = None, modified_since: int | None = None) -> Column:
    test = F.lit(True)
    if folder is not None:
        test = test & (F.col("folder") == folder)
    if tag is not None:
        test = test & F.array_contains("norm_tags", normalize_text(tag))
    if modified_since is not None:
        test = test & (F.col("mtime") >= modified_since)
    return test


def phrase_score(phrase: str, by: Whole = WHOLE) -> Column:
    part = F.lit(phrase)
    return (
        F.when(F.contains("norm_name", part), PHRASE_NAME)
        .when(F.contains("norm_path", part), PHRASE_PATH)
        .when(any_tag(lambda t: F.contains(t, part)), PHRASE_TAG)
        .when(by.content(phrase), PHRASE_CONTENT)
        .otherwise(0.0)
    )


def name_boost(term: str) -> Column:
    name = F.col("norm_name")
    fuzzy = fuzzy_score(name, term, lambda x: F.when(x >= FUZZY_LEAST, x * FUZZY_WEIGHT).otherwise(0.0))
    return F.when(name == term, NAME_EQUAL).when(name.startswith(term), NAME_PREFIX).when(name.contains(term), NAME_PART).otherwise(fuzzy)


def field_boosts(term: str) -> Column:
    path = F.when(F.col("norm_path").contains(term), PATH_PART).otherwise(0.0)
    tag = F.when(F.array_contains("norm_tags", term), TAG_EQUAL).when(any_tag(lambda t: F.contains(t, F.lit(term))), TAG_PART).otherwise(0.0)
    return name_boost(term) + path + tag


def term_weight(term: str, by: Whole = WHOLE) -> Column:
    """The term's frequency; from three characters on, without an exact hit, the weighted sum of the terms it starts."""
    exact = by.exact(term)
    return exact if len(term) < 3 else F.when(exact > 0, exact).otherwise(by.started(term) * PREFIX_WEIGHT)


def body_score(term: str, df: int, n_docs: int, average: float, by: Whole = WHOLE) -> Column:
    """BM25 of the body; a term no document holds exactly counts as held by one."""
    held = df or 1
    f, idf = term_weight(term, by), F.log(F.lit(1 + (n_docs - held + 0.5) / (held + 0.5)))
    length = f + K1 * (1 - B + B * (F.col("token_count") / max(1.0, average)))
    return F.when(f > 0, idf * (f * (K1 + 1) / length) * BODY_WEIGHT).otherwise(0.0)


def lexical_score(q: Query, dfs: dict[str, int], n_docs: int, average: float, by: Whole = WHOLE) -> Column:
    """Phrases and terms in order; a term that is given twice counts twice."""
    parts = [phrase_score(p, by) for p in q.phrases + q.required_phrases]
    parts += [field_boosts(t) + body_score(t, dfs.get(t, 0), n_docs, average, by) for t in q.terms + q.required_terms]
    return reduce(add, parts, F.lit(0.0))


def recency(now: int) -> Column:
    age = F.greatest(F.lit(0.0), (F.lit(now) - F.col("mtime")) / DAY)
    return 1 + RECENCY_WEIGHT * F.exp(-age / RECENCY_DAYS)
