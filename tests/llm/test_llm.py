import random
import re
import time
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeseek.llm import queries as llm
from lodeseek.llm.elite import ROUNDS, distinctive_terms, fit_two_poisson, typical_terms
from lodeseek.llm.fusion import best_by_every_score, fuse_ranks
from lodeseek.llm.lookalike import consistent, lookalikes, mapping, same_looking_classes, same_looking_pairs
from lodeseek.llm.markup import Folded, analyse, clean_markup, fold, line_blocks, unfold
from lodeseek.llm.mixing import mix, pivotal
from lodeseek.llm.neighbours import VectorIndex, scan_nearest, scan_range, unit
from lodeseek.llm.ngrams import marked_values, suffix_counts
from lodeseek.llm.packing import best_fit, pack, too_large
from lodeseek.llm.quality import STATISTICS, body_of, measure, quality
from lodeseek.llm.records import current_records
from lodeseek.llm.sizes import token_sizes, word_count
from tests.parity import SF, check

SQL = llm.oracle_sql()
RNG = random.Random(5)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    check(spark, llm.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(SQL)))
def test_query_runs(spark, name):
    assert llm.queries()[name](spark, SF).count() > 0


def test_forms_equal_sql(spark):
    sql = llm.oracle_sql()
    for name in ("p3_forms", "p3_classes", "p3_found"):
        check(spark, llm.queries()[name], sql[name])


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------- rank fusion

RESULTS = "result_id bigint, query_id bigint, path string, lexical_score double, semantic_score double, score double, _g string, position int"


def test_fusion(spark):
    data = [
        (1, 1, "a", 9.0, 0.1, 1e6, "x", 0), (2, 1, "a", 9.0, 0.1, 1e6, "x", 0), (3, 1, "b", 8.0, 0.9, float("nan"), "x", 0), (4, 1, "c", 8.0, None, float("-inf"), "x", 0),
        (5, 1, "d", None, float("nan"), None, "x", 0), (6, None, "a", 1.0, 1.0, 1.0, "x", 0), (7, 1, None, 99.0, 1.0, 1.0, "x", 0), (8, 2, "a", 0.0, 0.0, 0.0, "x", 0), (9, 1, "", 0.0, 0.5, 3.0, None, None),
    ]
    fused = fuse_ranks(spark.createDataFrame(data, RESULTS))
    got = {(r.query_id, r.path): r for r in fused.collect()}
    assert set(got) == {(1, "a"), (1, "b"), (1, "c"), (1, "d"), (1, ""), (2, "a")}
    a, b, c, d = (got[1, p] for p in "abcd")
    assert (a.lexical_score_rank, b.lexical_score_rank, c.lexical_score_rank, got[1, ""].lexical_score_rank) == (1, 2, 2, 4)
    assert b.score_rank is None and c.score_rank == 3 and d.fused == 0 and d.position == 5
    assert a.fused == pytest.approx(1 / 61 + 1 / 63 + 1 / 61) and a.position == 1
    assert rows(best_by_every_score(fused).select("query_id", "path")) == [(1, ""), (1, "a"), (2, "a")]
    assert fuse_ranks(spark.createDataFrame([], RESULTS)).count() == 0


def test_fusion_of_a_hot_query_against_brute_force(spark):
    data = [(i, 0 if i % 3 else i % 50, f"p{i}", float(RNG.randrange(40)), RNG.gauss(0, 1), RNG.lognormvariate(0, 9), "", 0) for i in range(3000)]
    got = {(r.query_id, r.path): r for r in fuse_ranks(spark.createDataFrame(data, RESULTS)).collect()}
    groups = defaultdict(list)
    for d in data:
        groups[d[1]].append(d)
    for own in groups.values():
        for k, name in ((3, "lexical_score_rank"), (4, "semantic_score_rank"), (5, "score_rank")):
            order = -np.sort(-np.array([d[k] for d in own]))
            for d in own:
                assert getattr(got[d[1], d[2]], name) == 1 + np.searchsorted(-order, -d[k])


# ---------------------------------------------------------------- markup


@pytest.mark.parametrize(
    "text, kinds",
    [
        ("a <b>x</b>", ["html"]), ("x<br/>y", ["html"]), ("<!-- c -->", ["html"]), ("a &amp; b", ["html"]), ("<p align=left\n id=n>t", ["html"]), ("&#8217; x", ["html"]),
        ("# Head\ntext", ["markdown"]), ("Head\n====\ntext", ["markdown"]), ("Head\n----\nx", ["markdown"]), ("a **b c** d", ["markdown"]), ("a _b_ c", ["markdown"]), ("- x\n- y", ["markdown"]), ("1. x\n2. y", ["markdown"]),
        ("- [ ] x", ["markdown"]), ("[a](http://b)", ["markdown"]), ("![a](b.png)", ["markdown"]), ("[a][1]\n\n[1]: http://x", ["markdown"]), ("use `x`", ["markdown"]), ("```\n<b>[[x]] $y$</b>\n```", ["markdown"]), ("> quote", ["markdown"]),
        ("| a | b |\n|---|---|\n| 1 | 2 |", ["markdown"]), ("~~x~~", ["markdown"]), ("a[^1]\n\n[^1]: b", ["markdown"]), ("---\ntags: [a]\n---\ntext", ["markdown"]), ("漢字**強調**です", ["markdown"]),
        ("[[Page]]", ["wiki"]), ("[[Page|text]]", ["wiki"]), ("== Head ==", ["wiki"]), ("a '''b''' c", ["wiki"]), ("{{t|a=1}}", ["wiki"]), ("{|\n! a !! b\n|-\n| 1 || 2\n|}", ["wiki"]), ("[https://x.y text]", ["wiki"]),
        ("\\section{A}\ntext", ["latex"]), ("so $x^2$ it is", ["latex"]), ("Here $y$ holds", ["latex"]), ("$$\na+b\n$$", ["latex"]), ("\\[ a \\]", ["latex"]), ("\\( a_i \\)", ["latex"]), ("\\begin{verbatim}\n# <b>\n\\end{verbatim}", ["latex"]), ("\\begin{itemize}\n\\item a\n\\end{itemize}", ["latex"]),
        ("<pre><code># x\n[[y]]</code></pre>", ["html"]), ("<ul><li>a</li></ul>\n== h ==", ["html", "wiki"]), ("<h1>T</h1>", ["html"]), ("\u200b#\u00a0Head\nx", ["markdown"]),
        ("plain, 5 * 3 * 2 < 9 and x > 8; $5 and $10, C# and #tag, Q&A", []), ("It lies in C:\\temp\\notes\\new26. A 31'' pipe, not a 79'' one", []), ("x_1 and y_2 -- not z; f_31_final_v2", []), ("He wrote [sic] and [1] left", []), ("a == b or a >= 33; done & dusted", []), ("22 -> 50 <- 22", []), ("The asterisk* means", []), ("If (a|b) = {1, 2} then", []), ("", []), (None, []),
    ],
)
def test_kinds_of_markup(text, kinds):
    assert analyse(text)[0] == kinds


def test_clean_text():
    text = "---\ntags: [a]\n---\n\nTitle\n=====\n\nSome **bold** and [[Page|wiki]] &amp; <i>html</i>.<br>Next `code` here.\n\n- [x] one\n- two\n\n```py\nx = '**no**'\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\nBy \\emph{far} $x_1^2$ best\\cite{k}.\n\n<!-- gone -->"
    assert analyse(text)[1] == "# Title\n\nSome bold and wiki & html.\nNext code here.\n\n- one\n- two\n\n```\nx = '**no**'\n```\n\na | b\n1 | 2\n\nBy far $x_1^2$ best."
    assert analyse("plain text") == ([], "plain text")


@pytest.mark.parametrize(
    "text, clean",
    [
        ("# Масса\nКот и **Москва**: $х_1$ и `сор`, Αθήνα", "# Масса\nКот и Москва: $х_1$ и `сор`, Αθήνα".replace("`", "")),
        ("```\nх = \uff11\u00a0\u200d\n```\n\\emph{ТЕСТ}", "```\nх = \uff11\u00a0\u200d\n```\n\nТЕСТ"),
        ("\u200b#\u00a0\uff28ead\n\u0645\u06cc\u200c\u062e **\u200fa\u00a0b** \U0001f469\u200d\U0001f4bb 1\ufe0f\u20e3 end.\u2060\nx", "# \uff28ead\n\u0645\u06cc\u200c\u062e \u200fa\u00a0b \U0001f469\u200d\U0001f4bb 1\ufe0f\u20e3 end.\u2060\nx"),
        ("\uff0a\uff0a\uff42\uff0a\uff0a [[\uff30|\uff54]]\n| \uff41 | b\u00a0c |\n|---|---|\n| 1 | \uff12 |", "\uff42 \uff54\n\uff41 | b\u00a0c\n1 | \uff12"),
        ("<b>\uff41</b>&amp;<pre>&lt;\uff42</pre>\n{|\n! \uff43 !! d\n|}\n== \uff44 ==\nе\n--\n---", None),
    ],
)
def test_clean_text_keeps_the_characters(text, clean):
    if clean is not None:
        assert analyse(text)[1] == clean
    folded = Folded(text, list(text))  # each character stands for itself
    assert unfold(folded) == text and unfold(fold(text)) == text
    for plain in (text, fold(text)):
        assert analyse(plain)[0] == analyse(text)[0]
        assert str(fold(analyse(text)[1])) == analyse(str(fold(text)))[1]


def test_line_blocks_drop_residue():
    assert [x for x in line_blocks(["|", "--", "", "", "", "Real words here", "more of them", "", "", "", "]]", "}"]) if x] == ["Real words here", "more of them"]


@pytest.mark.parametrize(
    "text, clean",
    [
        ("ok.", "ok."), ("Hi", "Hi"), ("# A\n\n\ntext", "# A\n\ntext"), ("5", "5"), ("- \U0001f389\n- x", "- \U0001f389\n- x"), ("one\n...\ntwo", "one\n...\ntwo"), ("?", "?"),
        ("| a | b |\n|---|---|\n| \u2713 | \u2717 |\n| - | - |\n| -- | |\n|  |  |", "a | b\n\u2713 | \u2717\n- | -\n-- |"), ("{|\n! a !! b\n|-\n| -- || --\n|}", "a | b\n-- | --"), ("<table><tr><td>-</td><td>-</td></tr><tr><td></td></tr></table>", "| - | -"),
        ("if (x) {\n  y();\n}\n->\n!!!", "if (x) {\n  y();\n}\n->\n!!!"), ("a\n\n---\n\n***\n\n}}\n|\n\nb", "a\n\nb"), ("\\textbf{a {b} c\n}\nd", None), ("---\n***", ""),
    ],
)
def test_short_and_sign_lines_stay(text, clean):
    got = analyse(text)[1]
    assert "}" not in got.split("\n") if clean is None else got == clean


def test_formulas_and_commands_of_any_size():
    formula = "$" + " + ".join(f"a_{i}*b_{i}" for i in range(200)) + "$"
    assert analyse(f"So {formula} holds") == (["latex"], f"So {formula} holds")
    assert analyse("\\emph{" * 5000 + "x\\cite{k}" + "}" * 5000 + " y")[1] == "x y"
    assert analyse("\\a[\\b[p]{q}]{z} \\emph{u {v} w} \\emph{t}")[1] == "z \\emph{u {v} w} t"


def test_furniture_of_pages_goes():
    page = "<nav><a href=/>Home</a> / About</nav>\n<h1>Title</h1>\n<p>Text with a <a href=x>link</a> in it.</p>\n<aside>see also</aside>\n<p>More.</p>\n<p><a href=y>Read on</a></p>\n<footer>Copyright / Terms</footer>"
    assert analyse(page)[1] == "# Title\n\nText with a link in it.\n\nsee also\n\nMore.\n\nRead on"
    assert analyse("<nav>Home</nav>") == (["html"], "Home") and analyse("<a href=x>One</a>\n<a href=y>Two</a>\n<a href=z>Three</a>")[1] == "One\nTwo\nThree"
    assert analyse("Home / About / Login\nAn article of some length.\nCopyright / Terms")[1] == "Home / About / Login\nAn article of some length.\nCopyright / Terms"
    assert analyse("<a href=x>- a</a>")[0] == ["html", "markdown"]


@pytest.mark.parametrize("text", ["\\begin{equation}", "\\begin{align}x\\end{equation}", "\\a{", "\\a[", "{{a|", "{|\n", "<a x=y ", "[[a", "$a ", "*a ", "_a_b", "<!--", "\\(", "> ", "<nav><a href=x>"])
def test_adversarial_texts_take_linear_time(text):
    times = []
    for n in (20_000, 80_000):
        began = time.process_time()
        analyse(text * n)
        times.append(time.process_time() - began)
    assert times[1] < 8 * times[0] + 1.0


def test_text_without_markup_comes_out_as_it_is(spark):
    for r in spark.read.parquet(f"{SF.replace('0.001', '0.1')}/notes.parquet").select("content").dropna().collect():
        kinds, clean = analyse(r.content)
        if not kinds and not re.search(r"^\W+$", r.content, re.M):
            assert "".join(clean.split()) == "".join(r.content.translate(dict.fromkeys([*range(1, 8), 14, 15])).split())


def test_markup_table(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (2, "# a", "k"), (None, "x" * 200_000 + " **y z**", "k")], "note_id bigint, content string, kinds string")
    got = {(r.note_id, tuple(r.kinds)) for r in clean_markup(df, ["note_id"]).collect()}
    assert got == {(1, ()), (2, ()), (2, ("markdown",)), (None, ("markdown",))}
    assert clean_markup(df.limit(0), ["note_id"]).count() == 0


# ---------------------------------------------------------------- look-alikes


def form(spark, text):
    table = mapping(lookalikes(spark))
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return unicodedata.normalize("NFC", "".join("".join(map(chr, table[ord(c)])) if ord(c) in table else c for c in text))


def test_consistent_forms(spark):
    alphabet = "aeoxAΑАеоѕé\u00e9\u0301\u0308\u0323\u200b\u00ad\u00a0\u3000ﬁＡ１2²\u1100\u1161\u11a8가각\uac00\u0345ǖ\U0001d11e\r\n\tßй\ufeff \u2126\u212b\u0f71\u0f72"
    texts = ["", "plain", "²³ stay", "Ａ１", "ﬁn", "Schlu\u0308ssel", "a\u0323\u0307 a\u0307\u0323", "\u0301x", "\u1100\u1161\u11a8", "x" * 50_000 + "\u0430" * 50_000]
    texts += ["".join(RNG.choice(alphabet) for _ in range(RNG.randrange(1, 30))) for _ in range(400)]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(-1, None, "k")], "id bigint, text string, _ch string")
    for r in consistent(df, ["id"], "text", "out").collect():
        assert r.out == (None if r.text is None else form(spark, r.text)), ascii(r.text)
    assert consistent(df.limit(0), ["id"], "text", "out").count() == 0


def test_same_looking_pairs(spark):
    v = [(1, "f", "Note"), (2, "f", "N\u043ete"), (3, "f", "Note"), (4, "f", "note"), (5, "f", "Notе\u200b"), (6, "g", "Note\u200b"), (7, "f", ""), (8, "f", None), (9, "f", "\u200b"), (10, "f", "x²"), (11, "f", "x2"), (None, "f", "Nоte")]
    df = spark.createDataFrame(v, "id bigint, field string, value string")
    assert rows(same_looking_pairs(df, "id", "field", "value")) == [(1, 2, "f"), (1, 5, "f"), (2, 3, "f"), (2, 5, "f"), (3, 5, "f")]
    assert same_looking_pairs(df.limit(0), "id", "field", "value").count() == 0
    classes = same_looking_classes(df, "id", "field", "value").collect()
    assert {(a.id, b.id, a.field) for a in classes for b in classes if a.id < b.id and a["class"] == b["class"] and a.spelling != b.spelling} == set(map(tuple, same_looking_pairs(df, "id", "field", "value").collect()))


def test_a_spelling_of_most_items_is_cut(spark, monkeypatch):
    from lodeseek.operators import skew

    monkeypatch.setattr(skew, "LOAD", 10)
    df = spark.createDataFrame([(i, "f", "N\u043ete" if i % 50 == 0 else "Note") for i in range(300)], "id bigint, field string, value string")
    got = sorted(map(tuple, same_looking_pairs(df, "id", "field", "value").select("id_a", "id_b").collect()))
    assert got == sorted((min(i, j), max(i, j)) for i in range(0, 300, 50) for j in range(300) if j % 50)


def test_shapes_of_letters(spark):
    pairs = {chr(a): chr(b) for a, b in lookalikes(spark)}
    assert len(pairs) > 150 and all(len(mapping(lookalikes(spark))[ord(a)]) == 1 for a in pairs)
    assert all(pairs[a] == b for a, b in zip("аеорсАВѕνοαρικօսցɑɡıᎪҺԚӏІ", "aeopcABsvoapikougagiAHQlI") if a in pairs) and len(set("αριօսցɑɡıᎪ") & set(pairs)) == 10
    assert not set(pairs) & set("éüßяжЖШΩπ日")
    data = spark.createDataFrame([(i, t) for i, t in enumerate(("ⅠⅡⅤ", "µm", "x²", "ſ", "ﬁ"))], "id bigint, text string")
    assert [r.out for r in consistent(data, ["id"], "text", "out").orderBy("id").collect()] == ["IIIV", "μm", "x²", "ſ", "fi"]


# ---------------------------------------------------------------- term scores and counts

DOCS = "path string, mtime bigint, size bigint, token_count bigint, tags array<string>, term_frequency map<string,bigint>, term string, x bigint"
RECORDS = [
    ("a", 1, 1, 10, ["old"], {"old": 5}, "c", 1), ("a", 2, 1, 10, ["#T", "t", "##u", "", None], {"The": 2, "the": 1, "rare": 4, "": 3, "void": 0, "neg": -2}, "c", 1),
    ("b", None, None, None, None, None, "c", 1), ("c", 5, 5, 8, ["t"], {"the": 3, "rare": 1}, "c", 1), ("d", 5, 5, 0, [], {"the": 1}, "c", 1), (None, 5, 5, 5, ["t"], {"the": 9}, "c", 1), ("e", 1, 1, 4, ["t"], {}, "c", 1),
]


def test_counts_and_marks(spark):
    records = current_records(spark.createDataFrame(RECORDS, DOCS))
    got = {(r.field, r.value): (r.total, r.records, r.mark) for r in marked_values(records).collect()}
    assert got == {("term", "the"): (7, 3, "common"), ("term", "rare"): (5, 2, "rare"), ("tag", "t"): (4, 3, "common"), ("tag", "#u"): (1, 1, "rare")}
    assert marked_values(records.limit(0)).count() == 0


@pytest.mark.parametrize("sigma", [1, 2, 3, 4])
def test_suffix_counts_against_brute_force(spark, sigma):
    data = [(i, [([RNG.choice("aaab\u00e9") for _ in range(RNG.randrange(0, 9))], RNG.randrange(0, 3)) for _ in range(RNG.randrange(0, 4))]) for i in range(60)]
    data += [(99, [(["a", None, "b", "b"], 1)]), (98, None)]
    df = spark.createDataFrame(data, "id int, s array<struct<values array<string>, weight bigint>>")
    totals, records = Counter(), defaultdict(set)
    for i, sequences in data:
        for values, weight in sequences or []:
            for at in range(len(values)):
                for n in range(1, sigma + 1):
                    gram = tuple(values[at : at + n])
                    if len(gram) == n and None not in gram and weight >= 1:
                        totals[gram] += weight
                        records[gram].add(i)
    got = suffix_counts(df, F.col("s"), sigma).collect()
    assert {tuple(r.ngram): (r.total, r.records) for r in got} == {g: (n, len(records[g])) for g, n in totals.items()}
    assert len(got) == len(totals)


def test_ngrams_of_tags_against_brute_force(spark):
    totals, records = Counter(), defaultdict(set)
    for i, r in enumerate(current_records(spark.read.parquet(f"{SF}/lexical_docs.parquet")).select("tags").collect()):
        tags = [None if t is None else t.lower().removeprefix("#") for t in r.tags or []]
        tags = [t for t in tags if t]
        for at in range(len(tags)):
            for n in range(1, min(3, len(tags) - at) + 1):
                gram = tuple(tags[at : at + n])
                totals[gram] += 1
                records[gram].add(i)
    got = llm.queries()["p7_ngrams"](spark, SF).collect()
    assert {tuple(r.ngram): (r.total, r.records) for r in got} == {g: (n, len(records[g])) for g, n in totals.items()}
    assert max(map(len, totals)) > 1


def test_term_scores(spark):
    got = {(r.path, r.term): r for r in distinctive_terms(spark.createDataFrame(RECORDS, DOCS)).collect()}
    assert set(got) == {("a", "the"), ("a", "rare"), ("c", "the"), ("c", "rare"), ("d", "the")}
    assert got["a", "rare"].tf == 4 and got["a", "the"].tf == 3 and got["a", "rare"].df == 2 and got["a", "the"].records == 5
    assert all(0 <= r.elite_probability <= 1 for r in got.values())
    assert got["a", "rare"].score > got["a", "the"].score
    assert rows(typical_terms(distinctive_terms(spark.createDataFrame(RECORDS, DOCS))).select("path", "term")) == [("a", "rare"), ("a", "the"), ("c", "rare"), ("c", "the")]
    assert distinctive_terms(spark.createDataFrame([], DOCS)).count() == 0


def test_two_poisson_recovers_a_mixture():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.where(rng.random(50_000) < 0.2, rng.poisson(6.0, 50_000), rng.poisson(0.4, 50_000)))
    x = np.arange(1, len(counts))
    share, low, high, p, ended, two = fit_two_poisson(np.zeros(len(x), int), x.astype(float), counts[1:].astype(float), np.array([float(counts[0])]))
    assert ended[0] and two[0]
    assert share[0] == pytest.approx(0.2, abs=0.01) and low[0] == pytest.approx(0.4, abs=0.03) and high[0] == pytest.approx(6, abs=0.1)
    assert p[0] < 0.1 and p[6] > 0.95 and (np.diff(p) >= -1e-12).all()


def test_two_poisson_has_ended():
    rng = np.random.default_rng(7)
    seg, x, n, zeros = [], [], [], []
    for term in range(300):
        records, rate = 5000, 10 ** rng.uniform(-3.5, 0.7)
        counts = np.bincount(np.where(rng.random(records) < rng.uniform(0, 0.6), rng.poisson(rate * rng.uniform(1, 9), records), rng.poisson(rate, records)), minlength=2)
        if counts[1:].any():
            at = np.flatnonzero(counts[1:]) + 1
            seg += [len(zeros)] * len(at)
            x, n = x + at.tolist(), n + counts[at].tolist()
            zeros.append(counts[0])
    args = np.array(seg), np.array(x, float), np.array(n, float), np.array(zeros, float)
    once, twice = fit_two_poisson(*args), fit_two_poisson(*args, 2 * ROUNDS)
    told = once[4] | once[5]
    assert told.mean() > 0.95 and abs(once[3] - twice[3])[told[args[0]]].max() <= 0.01
    assert not (once[5] & ~once[4]).any()  # only where one component does as well can the fit be left open


def test_a_term_found_everywhere_scores_low_by_the_mixture(spark):
    scored = distinctive_terms(spark.read.parquet(f"{SF.replace('0.001', '0.01')}/lexical_docs.parquet"))
    got = scored.groupBy((F.col("df") > 0.3 * F.col("records")).alias("common"), F.col("df").between(2, 10).alias("rare")).agg(F.max("score").alias("most"), F.median("score").alias("half")).collect()
    common, rare = next(r for r in got if r.common), next(r for r in got if r.rare)
    assert common.most < rare.half


# ---------------------------------------------------------------- neighbours

VECTORS = "vec_id bigint, path string, provider_id string, mtime bigint, size bigint, vector array<double>"


def test_scans_against_brute_force():
    rng = np.random.default_rng(2)
    centers = unit(rng.normal(size=(20, 64)))
    x = unit(centers[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 64)) * 0.05)
    q = x[::5]
    exact = q @ x.T
    a, b, c = scan_range(q, x, 0.9)
    assert len(a) >= 0.98 * (exact >= 0.9).sum() and (exact[a, b] >= 0.9).all() and np.allclose(exact[a, b], c)
    a, b, c = scan_nearest(q, x, 10)
    best = np.sort(-exact, axis=1)[:, 9]
    assert (exact[a, b] >= -best[a] - 1e-12).mean() >= 0.97 and np.bincount(a).max() == 10


def test_vector_pairs_and_neighbours(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 32))
    v = np.concatenate([base, base[:60] + rng.normal(size=(60, 32)) * 0.2, np.repeat(base[:1], 30, axis=0), base[5:6] * 1e200])
    data = [(i, "p", "one" if i % 10 else "two", 1, 1, r.tolist()) for i, r in enumerate(v)]
    data += [data[3], (9001, "p", None, 1, 1, v[0].tolist()), (9002, "p", "one", 1, 1, None), (9003, "p", "one", 1, 1, []), (9004, "p", "one", 1, 1, [0.0] * 32), (9005, "p", "one", 1, 1, [float("nan")] + [1.0] * 31), (9006, "p", "one", 1, 1, v[1].tolist()[:31]), (9007, "p", "one", 1, 1, [None] + [1.0] * 31)]
    df = spark.createDataFrame(data, VECTORS)
    u = unit(v)
    exact = u @ u.T
    same = np.array([[(i % 10 == 0) == (j % 10 == 0) for j in range(len(v))] for i in range(len(v))])
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if same[i, j] and exact[i, j] >= 0.9}
    got = rows(VectorIndex(df, 4).similar_pairs(0.9).select("vec_id_a", "vec_id_b"))
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.95 * len(want)
    near = VectorIndex(df, 12).nearest(df.filter("vec_id % 20 = 1"), 5).collect()
    hits = total = 0
    for i in {r.vec_id for r in near}:
        own = [r for r in near if r.vec_id == i]
        order = np.sort(np.where(same[i], exact[i], -9)[np.arange(len(v)) != i])[::-1]
        assert len(own) == 5 and i not in {r.neighbour for r in own} and sorted(r.place for r in own) == [1, 2, 3, 4, 5]
        hits, total = hits + sum(r.cosine >= order[4] - 1e-9 for r in own), total + 5
    assert hits >= 0.9 * total
    assert VectorIndex(df.limit(0), 4).similar_pairs().count() == 0


def test_no_list_that_can_hold_a_neighbour_is_left_out(spark):
    v = unit(np.random.default_rng(6).normal(size=(4000, 6)))  # no clusters at all
    df = spark.createDataFrame([(i, "p", "one", 1, 1, r.tolist()) for i, r in enumerate(v)], VECTORS)
    exact = v @ v.T
    a, b = np.nonzero(np.triu(exact >= 0.9, 1))
    pairs = VectorIndex(df, 1).similar_pairs(0.9).select("vec_id_a", "vec_id_b").toPandas()
    assert set(map(tuple, pairs.to_numpy())) == set(zip(a, b)) and len(pairs) == len(a)
    near = VectorIndex(df, 1).nearest(df.filter("vec_id % 20 = 1"), 5).collect()
    np.fill_diagonal(exact, -9)
    assert len(near) == 5 * 200 and all(r.cosine == pytest.approx(np.sort(exact[r.vec_id])[-r.place]) for r in near)


def test_crowded_lists_are_cut(spark, monkeypatch):
    from lodeseek.llm import neighbours

    for name, value in (("LIST_ROWS", 30), ("CUT_ROWS", 60), ("TOP_LISTS", 3), ("BLOCK_ROWS", 40), ("SAMPLE", 400), ("CUT_SAMPLE", 400)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(8)
    centers = rng.normal(size=(15, 16))
    v = unit(np.concatenate([centers[rng.integers(0, 15, 800)] + rng.normal(size=(800, 16)) * 0.25, rng.normal(size=(20, 16))]))
    df = spark.createDataFrame([(i, "p", "one" if i < 800 else "few", 1, 1, r.tolist()) for i, r in enumerate(v)], VECTORS)
    exact = np.where((np.arange(820) < 800)[:, None] == (np.arange(820) < 800)[None, :], v @ v.T, -9)
    index = VectorIndex(df, 2, epsilon=None)
    assert index.subs is not None and index.subs.count() > 10 and index.placed.count() == 820
    got = index.similar_pairs(0.9).select("vec_id_a", "vec_id_b").toPandas()
    want = set(zip(*map(lambda x: x.tolist(), np.nonzero(np.triu(exact >= 0.9, 1)))))
    assert set(map(tuple, got.to_numpy().tolist())) == want and len(got) == len(want) > 1000
    near = index.nearest(df.filter("vec_id % 20 = 1"), 5).collect()
    np.fill_diagonal(exact, -9)
    assert len(near) == 5 * 41 and all(r.cosine == pytest.approx(np.sort(exact[r.vec_id])[-r.place]) for r in near)


def test_recall_with_few_of_many_lists(spark, monkeypatch):
    from lodeseek.llm import neighbours

    monkeypatch.setattr(neighbours, "LIST_ROWS", 20)
    rng = np.random.default_rng(9)
    centers = rng.normal(size=(60, 64))
    v = unit(centers[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 64)) * 0.6)
    df = spark.createDataFrame([(i, "p", "one", 1, 1, r.tolist()) for i, r in enumerate(v)], VECTORS)
    exact = v @ v.T
    np.fill_diagonal(exact, -9)
    near = VectorIndex(df, 3).nearest(df.filter("vec_id % 20 = 0"), 10).collect()
    assert sum(r.cosine >= np.sort(exact[r.vec_id])[-10] - 1e-9 for r in near) >= 0.95 * 150 * 10


def _shuffled(spark) -> int:
    """Rows that the session's stages have written for shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_links_do_not_copy_vectors_for_each_list(spark, monkeypatch):
    from lodeseek.llm import neighbours

    for name, value in (("LIST_ROWS", 20), ("UNIT_ROWS", 1500), ("LEAST_UNIT_ROWS", 100)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(12)
    loose = rng.normal(size=(4000, 64))  # every list can hold a vector that is near
    loose[3700:] = loose[:300] + rng.normal(size=(300, 64)) * rng.uniform(0.1, 0.6, size=(300, 1))
    tight = rng.normal(size=(60, 64))[rng.integers(0, 60, 2000)] + rng.normal(size=(2000, 64)) * 0.3
    v = unit(np.concatenate([loose, tight]))
    df = spark.createDataFrame([(i, "p", "loose" if i < 4000 else "tight", 1, 1, r.tolist()) for i, r in enumerate(v)], VECTORS)
    index, before = VectorIndex(df), _shuffled(spark)
    got = index.links(0.9).toPandas()
    assert _shuffled(spark) - before < 20 * len(v)
    exact = v @ v.T
    exact[:4000, 4000:] = -9
    a, b = np.nonzero(np.triu(exact >= 0.9, 1))
    assert set(zip(got["rep_a"], got["rep_b"])) == set(zip(a, b)) and len(got) == len(a) > 5000
    assert np.allclose(exact[got["rep_a"], got["rep_b"]], got["cosine"], atol=1e-12)


# ---------------------------------------------------------------- packing and mixing


def test_sizes(spark):
    df = spark.createDataFrame([("a b_1, c-d 日本",), ("",), (None,), ("...",)], "text string")
    assert [r.n for r in df.select(word_count(F.col("text")).alias("n")).collect()] == [5, 0, 0, 0]
    import public_tokenizers

    got = token_sizes(df, public_tokenizers.path("byte_bpe_50k.tiktoken"), ["text"]).collect()
    assert [r.size > 0 for r in got] == [True, False, False, True]


def test_best_fit_is_tight():
    histogram = {s: RNG.randrange(0, 60) for s in range(1, 65)}
    runs, bins = best_fit(histogram, [16, 32, 64])
    filled = Counter()
    for size, first, each, at, n in runs:
        for b in range(at, at + n):
            filled[b] += size * each
    for at, n, content, length in bins:
        for b in range(at, at + n):
            assert filled.pop(b) == content <= length and length in (16, 32, 64)
    assert not filled
    placed = Counter()
    for size, first, each, at, n in runs:
        assert placed[size] == first
        placed[size] += each * n
    assert placed == Counter({s: n for s, n in histogram.items() if n})
    assert sum(s * n for s, n in histogram.items()) >= 0.98 * sum(n * length for _, n, _, length in bins)


def test_packing(spark):
    sizes = [(i, RNG.choice([0, 1, 5, 9, 30, 31, 64, 65, 200, None])) for i in range(900)] + [(7, 3), (7, 3), (None, 4)]
    df = spark.createDataFrame(sizes, "doc_id bigint, size bigint")
    limits = spark.createDataFrame([("s", 32), ("l", 64), ("l", 64), (None, 5), ("bad", None), ("zero", 0)], "limit_name string, capacity bigint")
    got = pack(df, limits).collect()
    for name, capacity in (("s", 32), ("l", 64)):
        own = [r for r in got if r.limit_name == name]
        fill, length = Counter(), {}
        assert sum(r.piece_size for r in own) == sum(s or 0 for _, s in sizes)
        for r in own:
            assert (r.container is None) == (r.piece_size == 0) and r.pieces == max(1, -(-((r.pieces - 1) * capacity + 1) // capacity))
            if r.container is not None:
                fill[r.container] += r.piece_size
                length[r.container] = (r.fill, r.length)
        assert all(fill[c] == length[c][0] <= length[c][1] <= capacity for c in fill)
    assert {tuple(r) for r in too_large(pack(df, limits)).collect()} == {(n, i) for i, s in sizes for n, c in (("s", 32), ("l", 64)) if (s or 0) > c}
    assert pack(df.limit(0), limits).count() == 0 and pack(df, limits.limit(0)).count() == 0


def test_pivotal_keeps_sums_and_expectations():
    parts, sizes = np.full(500, 0.37), np.random.default_rng(4).pareto(1.2, 500) * 50 + 1
    sizes[:5] = 0
    means = np.zeros(500)
    for seed in range(400):
        take, held = pivotal(own := parts.copy(), sizes, seed)
        left = own[held] * sizes[held] if held >= 0 else 0
        assert (take * sizes).sum() + left == pytest.approx((parts * sizes).sum())
        means += take + (np.arange(500) == held) * (own[held] if held >= 0 else 0)
    assert abs(means / 400 - 0.37).max() < 0.12 and abs(means.mean() / 400 - 0.37) < 0.01


def test_mixing(spark, monkeypatch):
    from lodeseek.llm import mixing

    monkeypatch.setattr(mixing, "BLOCK", 50)
    monkeypatch.setattr(mixing, "FAN_IN", 4)
    sizes = [(i, "big", RNG.randrange(1, 90)) for i in range(2000)] + [(i, "mid", 20) for i in range(2000, 2400)] + [(i, "tiny", 10) for i in range(2400, 2410)] + [(1, "unlisted", 9), (2, None, 5), (3, "mid", None), (2001, "mid", 20)]
    df = spark.createDataFrame(sizes, "doc_id bigint, source string, size bigint")
    targets = spark.createDataFrame([("big", 30.0, 1), ("mid", 10.0, 3), ("tiny", 60.0, 4), ("none", 1.0, 2), (None, 9.0, 1), ("zero", 0.0, 1), ("nan", float("nan"), 1)], "source string, weight double, max_repeats bigint")
    drawn, report = mix(df, targets)
    report = {r.source: r for r in report.collect()}
    assert set(report) == {"big", "mid", "tiny", "none"}
    assert {s for s, r in report.items() if not r.fills} == {"tiny", "none"}
    caps = {"big": 1, "mid": 3, "tiny": 4}
    drawn = drawn.collect()
    assert all(0 < r.copies <= caps[r.source] for r in drawn)
    for s in ("big", "mid"):
        assert report[s].reached_size == pytest.approx(report[s].target_size, rel=0.005)
    assert report["tiny"].reached_size == 4 * report["tiny"].size and report["none"].reached_size == 0
    assert sum(r.reached_share for r in report.values()) == pytest.approx(1)
    assert rows(mix(df, targets)[0]) == sorted(map(tuple, drawn), key=repr)
    empty = mix(df.limit(0), targets)
    assert empty[0].count() == 0 and {r.reached_size for r in empty[1].collect()} == {0}
    assert mix(df, targets.limit(0))[1].count() == 0


# ---------------------------------------------------------------- quality


def test_quality_on_labels(spark):
    sf = SF.replace("0.001", "0.1")  # kinds are told by their labelled documents, of which smaller tables have a handful
    d = spark.read.parquet(f"{sf}/documents.parquet")
    labels, common = spark.read.parquet(f"{sf}/quality_labels.parquet"), spark.read.parquet(f"{sf}/common_words.parquet")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n "), (-4, "x " * 60_000), (-5, "a\n\n- b")], "doc_id bigint, text string")
    got = quality(d.select("doc_id", "text").unionByName(extra).withColumn("stats", F.lit(1)).withColumn("label", F.lit("k")), labels, common).cache()
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == d.count() + 5
    assert all(by[i].verdict == "junk" for i in (-1, -2, -3, -4))
    given = [r for r in labels.dropna().collect() if r.doc_id in by]
    assert sum(by[r.doc_id].verdict == r.label for r in given) >= 0.85 * len(given)  # some labels are wrong
    some = by[given[0].doc_id]
    assert some.distance == 0 or sum(some.contributions.values()) == pytest.approx(1)
    none = quality(d.limit(0), labels, common)
    assert none.count() == 0
    unlabelled = quality(extra, labels.limit(0), common.limit(0)).collect()
    assert {r.doc_id: r.verdict for r in unlabelled}[-5] == "prose"


def test_statistics_are_of_the_whole_text(spark):
    common = spark.createDataFrame([("en", w) for w in ("the", "and", "of", "it")], "lang string, word string")
    texts = {1: "The first line of wrapped prose ends\nonly here, and it is long.", 2: "Only words 7\n*** ***", 3: "Head\n\nThe body of it.", 4: None}
    df = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in quality(df, spark.createDataFrame([], "doc_id bigint, label string"), common).collect()}
    assert {i: r.words for i, r in got.items()} == {1: 13, 2: 3, 3: 5, 4: 0}
    listed = {"en": frozenset(("the", "and", "of", "it"))}
    for i, r in got.items():
        assert [r[n] for n in STATISTICS] == pytest.approx(measure(texts[i], listed)[2])
        assert [r[f"body_{n}"] for n in STATISTICS] == pytest.approx(measure(body_of(texts[i] or ""), listed)[2])
    assert got[1].digit_share == 0 and got[2].digit_share > 0 == got[2].body_digit_share


def test_statistics_are_as_measured(spark):
    common = spark.createDataFrame([("en", w) for w in ("the", "and", "of", "it")], "lang string, word string")
    texts = [(1, "the end of it " * 30), (2, "雨の後で見る。\n\n棚を直した。"), (3, "")]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, label string"), common).collect()}
    assert (got[1].common_share, got[1].line_words, got[1].body_common_share) == (0.75, 120, 0.75)
    assert (got[2].language, got[2].words, got[2].word_length, got[2].vocabulary) == ("ja", 2, 5.5, 1)
    assert got[2].common_share == 0 and got[2].line_words == 1 and got[3].vocabulary == 0
