"""Per-document text statistics and a verdict that tells prose from lists, tables and junk.

Every document is measured by the statistics in ``STATISTICS``, over its whole
text, and once more over its body, the text without a heading or a sentence right
before it (``body_`` and the name). Prose has, per language, a robust mean and
covariance of the body's; a document's squared Mahalanobis distance from its
language's prose says how far it is from prose, and the distance is reported with
each statistic's contribution to it. A document beyond the language's cutoff is no
prose; its kind is that of the labelled documents nearest to it among those beyond the cutoff.

The statistics are reported as measured. The distance is taken over features made
of them: clipped where more says nothing, on a log scale for words a line, and for
Japanese, which has no blanks between words, by its characters.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeseek.runtime import materialize, spread

STATISTICS = (
    "word_length", "common_share", "letter_share", "digit_share", "symbol_share", "mixed_share", "line_words", "ended_share",
    "item_share", "cell_share", "repeat_share", "furniture_share", "garbled_share", "machine_share", "vocabulary",
)
#: Least spread of each statistic, so that one that never varies in prose still has a scale.
_FLOOR = np.array([0.35, 0.02, 0.03, 0.03, 0.03, 0.04, 0.6, 0.8, 0.06, 0.06, 0.06, 0.05, 0.03, 0.05, 0.12])
#: Labelled documents the model is fitted on, and those of them that kinds are told by, at most about.
SAMPLE, REFERENCES = 40_000, 4_000
#: Neighbours that vote on a kind, at most.
VOTERS = 15
#: A text with this share of common words has enough of them; more says nothing.
COMMON_ENOUGH = 0.3
#: Lines of more words are simply long.
LONG_LINE = 40
KINDS = ("list", "table", "junk")
#: What tells the kinds apart counts in full, the other features a little.
_TELLING = ("item_share", "cell_share", "repeat_share", "furniture_share", "garbled_share", "machine_share")
_FAINT = 0.02

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_ENDS, _CLOSERS = frozenset(".!?。！？…:;"), "\"'”’»)]"
_ITEM = re.compile(r"^\s*(?:[-*+•–]\s+(?:\[[ xX]\]\s+)?|\(?\d{1,3}[.)]\s+|\(?[a-zA-Z][.)]\s+|\d{4}-\d\d-\d\d\s+|\d{1,2}\.\d{1,2}\.(?:\d{2,4})?\s+|[☐☑✓✔]\s*)\S")
_LEADER = re.compile(r"(?:\.{2,}|[^\W\d_])\s*\d{1,4}\s*$")
_LINKED = re.compile(r"\bhttps?://\S+\s*$")
_GAP = re.compile(r"\S(?:\s{2,}|\t)(?=\S)")
_LOG = re.compile(r"\d\d:\d\d:\d\d\S*\s+\[?(?:[A-Z]{3,}|\[)|\b(?:DEBUG|INFO|WARN|WARNING|ERROR|FATAL|TRACE)\b|^\s*at [\w.$]+\(|^\S+\[\d+\]:")
_LOG_SIGNS = ("DEBUG", "INFO", "WARN", "ERROR", "FATAL", "TRACE", "]:")
_TIME = re.compile(r"\d:\d\d:\d\d")
_DUMP = re.compile(r"^\s*(?:0x)?[0-9a-fA-F]{6,16}:?\s+(?:[0-9a-fA-F]{2,8}\s+){3,}|^[A-Za-z0-9+/=_-]{40,}$|^\s*[\[{<].*[\]}>],?\s*$")
_MOJIBAKE = re.compile(r"[\u00c2-\u00f4][\u0080-\u00bf]|[\u00d0\u00d1\u00c3\u00c2](?=[\u00d0\u00d1\u00c3\u00c2\u0080-\u00bf\u20ac\u201a-\u2122])")
_WRAP = re.compile(r"(?<=\S)[ \t]*\n[ \t]*(?=\S)")
_STOP = re.compile(r"[.!?。！？](?=\s|$)")
_RULE = re.compile(r"^[\s+|=:*_-]*$")
# Phrases of page furniture.
_FURNITURE = re.compile(
    r"^\W*(?:log ?in|log ?out|sign (?:in|up)|menu|loading|home|about|contact|share(?: this(?: page)?)?|back to top|skip to (?:content|main)|sort by\b.*|page \d+(?: of \d+)?|\d+ comments?|"
    r"accept(?: all)?(?:\W+reject(?: all)?)?|reject(?: all)?|next\b.*previous\b.*|previous\b.*next\b.*|next|previous|prev|read more|show more|load more|subscribe(?: now)?|search|print|"
    r"privacy(?: policy)?|terms(?: of (?:use|service))?|cookies?\b.*|all rights reserved.*|copyright\b.*|©.*|advertisement|follow us|register|home\s*[|>»/].*|click here|tags|categories|archive|newer posts?|older posts?|reply|edit|close)\W*$",
    re.I,
)


# Classes of characters: the first four exclude each other, the others are flags.
_LETTER, _DECIMAL, _SPACE, _PLAIN, _CJK, _KANA, _BROKEN, _WORDLY = 1, 2, 3, 4, 8, 16, 32, 64
#: Which classes each of the counts in ``measure`` sums.
_SUMS = np.array([[k & 7 == c for c in (_LETTER, _DECIMAL, _SPACE, _PLAIN)] + [k & f > 0 for f in (_CJK, _KANA, _BROKEN, _WORDLY)] for k in range(128)], dtype=np.int64)
_USUAL = ".,'’-!?、。:;\"«»“”„()"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if ch.isalpha():
            table[cp] = _LETTER | _WORDLY
        elif ch.isdecimal():
            table[cp] = _DECIMAL | _WORDLY
        elif ch.isspace():
            table[cp] = _SPACE
        elif ch in _USUAL:
            table[cp] = _PLAIN
        elif ch.isalnum() or ch == "_":
            table[cp] = _WORDLY
    for a, b, flag in ((0x3040, 0x30FF, _CJK | _KANA), (0x3400, 0x9FFF, _CJK), (0x25A0, 0x25FF, _BROKEN), (0, 8, _BROKEN), (0xE, 0x1F, _BROKEN)):
        table[a : b + 1] |= flag
    for cp in (0xFFFD, 0xA4, 0xA7, 0xFF):
        table[cp] |= _BROKEN
    return table


#: First words of the phrases above.
_FURNITURE_STARTS = frozenset(
    "log login logout sign menu loading home about contact share back skip sort page comment comments accept reject next previous prev read show load subscribe search print privacy terms "
    "cookie cookies all copyright advertisement follow register click tags categories archive newer older reply edit close".split()
)


def _ended(line: str) -> bool:
    return line.rstrip().rstrip(_CLOSERS)[-1:] in _ENDS and bool(line.strip())


def _mixed(codes: np.ndarray, kinds: np.ndarray, text: str) -> int:
    """Number of tokens in which letters and digits, or words and one of ``=/+``, stand side by side; addresses are none."""
    base = kinds & 7
    digit, letter = base == _DECIMAL, ((kinds & _WORDLY) > 0) & (base != _DECIMAL) & (codes != 0x5F)
    near = np.zeros(len(codes), dtype=bool)
    near[1:] = (digit[:-1] & letter[1:]) | (letter[:-1] & digit[1:])
    if "=" in text or "/" in text or "+" in text:
        joint, word = (codes == 0x3D) | (codes == 0x2F) | (codes == 0x2B), (kinds & _WORDLY) > 0
        near[1:-1] |= joint[1:-1] & word[:-2] & word[2:]
    if not near.any():
        return 0
    space = base == _SPACE
    token = np.cumsum(space)  # the same for all characters of a token
    hit = set(token[near].tolist())
    if "://" in text:
        at = np.flatnonzero((codes[:-2] == 0x3A) & (codes[1:-1] == 0x2F) & (codes[2:] == 0x2F))
        hit -= set(token[at].tolist())
    return len(hit)


def _flowing(lines: list[str], words: list[list[str]], common: frozenset[str]) -> set[int]:
    """Numbers of the lines in paragraphs that are sentences broken over lines."""
    found: set[int] = set()
    start = 0
    for at in range(len(lines) + 1):
        if at < len(lines) and lines[at].strip():
            continue
        if at - start > 1 and _ended(lines[at - 1]):
            own = [w for line in words[start:at] for w in line]
            if own and sum(map(common.__contains__, own)) >= 0.22 * len(own) and len(own) <= 45 * sum(len(_STOP.findall(x)) for x in lines[start:at]):
                found.update(range(start, at))
        start = at + 1
    return found


def _cells(lines: list[str], text: str) -> int:
    """Number of lines that are rows of cells: three or more lines cut by one separator into a steady number of short cells."""
    if len(lines) < 2:
        return 0
    best = 0
    for mark in ("|", "\t", ";", ","):
        if mark not in text:
            continue
        counts = [line.count(mark) for line in lines]
        some = [c for c in counts if c >= (2 if mark in ",;" else 1)]
        if len(some) < 3:
            continue
        usual, n = Counter(some).most_common(1)[0]
        if mark in ",;|" and n < 0.6 * len(some):
            continue
        rows = [line for line, c in zip(lines, counts) if c and (c == usual or mark == "\t")]
        words = sum(len(line.split()) for line in rows) / sum(line.count(mark) + 1 for line in rows)
        if words <= 6:
            best = max(best, len(rows))
    if "  " not in text and "\t" not in text and text.isascii():
        return best
    gaps = [len(_GAP.findall(line.strip())) for line in lines]
    wide = sum(g >= 2 for g in gaps)
    return max(best, sum(g >= 1 for g in gaps)) if wide >= 3 or (wide >= 2 and wide >= 0.5 * len(lines)) else best


def _repeated(low: str) -> tuple[float, int]:
    """Share of the sentences' length that has stood before, and the number of sentences."""
    for stop in ".!?。！？":
        low = low.replace(stop, "\n")
    sentences = [" ".join(x.split()) for x in low.split("\n")]
    total = sum(map(len, sentences))
    return (total - sum(map(len, set(sentences)))) / (total or 1), sum(map(bool, sentences))


def body_of(text: str) -> str:
    """``text`` without a first line of at most one sentence that has the body right under it, which tells nothing of the body."""
    head, _, rest = text.partition("\n")
    cut = head.strip() and rest.strip() and rest[0] not in "\r\n" and len(rest) >= 0.3 * len(head) and len(_STOP.findall(head)) <= 1
    return rest if cut else text


def measure(text: str | None, common: dict[str, frozenset[str]]) -> tuple[str, int, list[float], int, list[float]]:
    """(language or '', number of words, the statistics, number of letter runs or Japanese characters, the features) of one text.

    A word is a maximal run of letters, numbers and underscore in any language.
    ``garbled_share`` counts a broken sign three times and a pair of wrongly
    decoded ones twice, so it may pass 1.
    """
    text = text or ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = _classes()[codes]
    letters, digits, spaces, usual, cjk, kana, broken, wordly = (np.bincount(kinds, minlength=128) @ _SUMS).tolist()
    dense = len(text) - spaces or 1
    inside = np.concatenate(([False], (kinds & _WORDLY) > 0))
    count = int(np.count_nonzero(inside[1:] & ~inside[:-1]))
    low = text.lower()
    every = text.splitlines()
    split = [_WORD.findall(x) for x in low.splitlines()]
    words = [w for line in split for w in line]
    tokens = text.split()
    counts = Counter(words)
    hits = {k: sum(counts[w] for w in counts.keys() & v) for k, v in common.items()}
    if cjk * 3 > letters:
        language = "ja"
    else:
        best = max(hits, key=lambda k: (hits[k], k), default="")
        language = best if best and hits[best] and hits[best] >= 0.02 * len(words) else ""
    known = common.get(language, frozenset())
    share = hits.get(language, 0) / max(len(words), 1)
    vocabulary = math.log1p(len(counts)) / math.log1p(max(len(words), 1))
    lines = [i for i, x in enumerate(every) if x.strip() and not _RULE.match(x)]
    weights = [len(every[i].strip()) for i in lines]
    ended = [_ended(every[i]) for i in lines]
    whole = sum(weights) or 1
    item = furniture = machine = 0
    flowing = _flowing(every, split, known)
    logged = any(x in text for x in _LOG_SIGNS) or (":" in text and _TIME.search(text)) or ("(" in text and "at " in text)  # what a line of a log holds
    for i, w, end in zip(lines, weights, ended):
        line, own = every[i], split[i]
        if (not own or own[0] in _FURNITURE_STARTS or "©" in line) and _FURNITURE.match(line):
            furniture += w
        elif (logged and _LOG.search(line)) or _DUMP.match(line):
            machine += w
        elif end and len(own) >= 8 and sum(map(known.__contains__, own)) >= 0.15 * len(own):
            continue  # a sentence, with or without a mark before it
        elif i in flowing or (language == "ja" and len(line) >= 16 and end):
            continue
        elif _ITEM.match(line) or (len(line) < 90 and _LEADER.search(line)) or ("://" in line and len(line.split()) < 12 and _LINKED.search(line)):
            item += w
        elif not end and len(line) <= 60 and language != "ja":
            item += w if len(lines) > 1 and len(own) <= 7 and sum(map(known.__contains__, own)) <= 0.34 * len(own) else 0
        elif len(line) > 60 and (parts := line.count(",")) >= 3 and len(line.split()) <= 5.5 * (parts + 1) and not end:
            item += w
        elif language == "ja" and len(lines) > 2 and len(line) <= 16 and not end:
            item += w
    repeat, sentences = _repeated(low)
    unwrapped = _WRAP.sub(" ", low) if "\n" in low.replace("\n\n", "") else low
    if unwrapped != low:
        more, sentences = _repeated(unwrapped)
        repeat = max(repeat, more)
    if len(words) >= 20 and len(words) > 60 * sentences:  # the same few words over and over without an end of a sentence
        grams = len(set(zip(words, words[1:], words[2:])))
        repeat = max(repeat, (0.4 - grams / (len(words) - 2)) / 0.4)
    symbols = len(text) - spaces - letters - digits - usual
    garbled = (2 * (0 if text.isascii() else len(_MOJIBAKE.findall(text))) + 3 * broken) / dense
    if cjk * 3 <= letters and max(map(len, tokens), default=0) > 60 and any(len(t) > 60 and any(map(str.isalnum, t)) for t in tokens):
        machine = max(machine, sum(len(t) for t in tokens if len(t) > 60))
    line_words = len(tokens) / max(len(lines), 1)
    stats = [
        wordly / max(count, 1), share, letters / dense, digits / dense, symbols / dense, _mixed(codes, kinds, text) / max(len(tokens), 1),
        line_words, sum(ended) / max(len(lines), 1),
        item / whole, _cells([every[i] for i in lines], text) / max(len(lines), 1), repeat, furniture / whole, garbled, machine / whole, vocabulary,
    ]
    runs, length = len(words), sum(map(len, words)) / max(len(words), 1)
    if language == "ja":
        runs, length, vocabulary, line_words = cjk, 4.5, 0.5, cjk / 2 / max(len(lines), 1)
        share = 0.7 * kana / max(cjk, 1)  # kana stands for grammar
    made = {
        "word_length": length, "common_share": min(share, COMMON_ENOUGH), "line_words": math.log1p(min(LONG_LINE, line_words)),
        "garbled_share": min(garbled, 1.0), "vocabulary": vocabulary if runs else 1.0,
    }
    return language, count, stats, runs, [made.get(n, v) for n, v in zip(STATISTICS, stats)]


def fit_robust(x: np.ndarray, keep: float = 0.8, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the ``keep`` share of the rows that lies closest together (concentration steps)."""
    center = np.median(x, axis=0)
    spread = np.maximum(1.4826 * np.median(np.abs(x - center), axis=0), _FLOOR)
    far = (((x - center) / spread) ** 2).sum(axis=1)
    cov = np.diag(spread**2)
    for _ in range(rounds):
        own = x[np.argsort(far, kind="stable")[: max(2, int(keep * len(x)))]]
        center = own.mean(axis=0)
        cov = np.cov(own.T) if len(own) > 2 else np.diag(spread**2)
        cov = np.atleast_2d(cov) + np.diag(_FLOOR**2)
        diff = x - center
        far = np.einsum("ij,jk,ik->i", diff, np.linalg.inv(cov), diff)
    return center, cov


def fit_prose(labelled: pd.DataFrame, prior: int = 20) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Per language, and '' for all others: prose mean, inverse covariance and cutoff, from labelled documents.

    A language's mean and covariance are drawn toward those of all prose by
    ``prior`` documents' weight. The cutoff is the distance that divides the labels
    with the fewest errors; labels may be wrong.
    """
    x = np.array(labelled["features"].tolist(), dtype=np.float64).reshape(-1, len(STATISTICS))
    prose = (labelled["label"] == "prose").to_numpy()
    language = labelled["language"].to_numpy()
    if not prose.any():
        return {}
    mean, cov = fit_robust(x[prose])
    model = {}
    for name in sorted(set(language) | {""}):
        own = prose & (language == name)
        center, spread = mean, cov
        if own.sum() >= 5 and name:
            m, c = fit_robust(x[own])
            w = own.sum() / (own.sum() + prior)
            center, spread = w * m + (1 - w) * mean, w * c + (1 - w) * cov
        model[name] = (center, np.linalg.inv(spread))
    far = np.array([_distance(v, model[k])[0] for v, k in zip(x, language)])
    order = np.argsort(far, kind="stable")
    errors = np.concatenate([[prose.sum()], prose.sum() - np.cumsum(prose[order]) + np.cumsum(~prose[order])])
    best = np.flatnonzero(errors == errors.min())
    at = int(best[len(best) // 4])
    cutoff = 0.5 * (far[order[at - 1]] + far[order[at]]) if 0 < at < len(far) else float(far.max()) + 1.0
    return {k: (c, i, float(cutoff)) for k, (c, i) in model.items()}


def _distance(x: np.ndarray, model) -> tuple[float, np.ndarray]:
    diff = x - model[0]
    parts = diff * (model[1] @ diff)
    return float(parts.sum()), parts


def _telling(x: np.ndarray) -> np.ndarray:
    """Features in which documents of one kind lie close to each other."""
    own = x[:, [STATISTICS.index(n) for n in _TELLING]]
    return np.concatenate([own, np.clip(x / _FLOOR, -20, 20) * _FAINT], axis=1)


def fit_kinds(labelled: pd.DataFrame, model: dict) -> tuple[np.ndarray, np.ndarray]:
    """(features, number of the kind) of the labelled lists, tables and junk beyond the cutoff, in the order given, at most ``REFERENCES``."""
    rows = labelled[labelled["label"].isin(KINDS)]
    x = np.array(rows["features"].tolist(), dtype=np.float64).reshape(-1, len(STATISTICS))
    far = [size == 0 or _distance(v, m := model.get(k) or model[""])[0] > m[2] for v, k, size in zip(x, rows["language"], rows["size"])] if model else [True] * len(x)
    far = np.array(far, dtype=bool)
    return _telling(x[far])[:REFERENCES], np.array([KINDS.index(k) for k in rows["label"].to_numpy()[far]], dtype=np.int64)[:REFERENCES]


def kinds_of(x: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The kind of each row of features: the vote of its nearest references, weighed by closeness; junk without any."""
    references, labels = known
    if not len(references) or not len(x):
        return np.full(len(x), "junk", dtype=object)
    own = _telling(x)
    far = np.sqrt(np.maximum((own**2).sum(axis=1)[:, None] + (references**2).sum(axis=1)[None, :] - 2 * own @ references.T, 0))
    voters = min(VOTERS, max(3, len(references) // 12), len(references))
    near = np.argsort(far, axis=1, kind="stable")[:, :voters]
    weight = 1 / (0.03 + np.take_along_axis(far, near, axis=1))
    votes = np.stack([(weight * (labels[near] == k)).sum(axis=1) for k in range(len(KINDS))], axis=1)
    return np.array(KINDS, dtype=object)[votes.argmax(axis=1)]


def quality(documents: DataFrame, labels: DataFrame, common_words: DataFrame) -> DataFrame:
    """(doc_id, language, words, the statistics, the body's, distance, contributions, verdict) of every document.

    ``verdict`` is prose, list, table or junk; ``words`` counts maximal runs of
    letters, numbers and underscore; ``contributions`` maps each statistic to the share of the body's feature in the squared distance (negative where it offsets others).
    ``common_words`` (lang, word) must fit a broadcast; the prose model is
    fitted on at most about ``SAMPLE`` labelled documents, taken by a hash of the id.

    The language is found in the text, by its common words or script, as the
    given one may be wrong; texts without any have language null. A null,
    empty or blank text is junk. Without labels for prose every other text is prose;
    without labels for other kinds what is no prose is junk.
    Repeated ids are documents of their own; ids and labels of null are not used for fitting.
    """
    spark = documents.sparkSession
    words: dict[str, set[str]] = {}
    for r in common_words.select("lang", "word").dropna().collect():
        words.setdefault(r.lang.lower(), set()).add(r.word.lower())
    shared = spark.sparkContext.broadcast({k: frozenset(v) for k, v in words.items()})

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["_text"]):
                body = body_of(text or "")
                whole = measure(text, shared.value)
                own = whole if body == (text or "") else measure(body, shared.value)
                out.append((doc, *whole[:3], own[0], *own[2:]))
            yield pd.DataFrame(out, columns=measures)

    measures = ["doc_id", "language", "words", "stats", "body_language", "body", "size", "features"]
    types = [documents.schema["doc_id"].dataType.simpleString(), "string", "bigint", "array<double>", "string", "array<double>", "bigint", "array<double>"]
    rows = spread(documents.select("doc_id", F.col("text").alias("_text"))).mapInPandas(measured, ", ".join(f"{n} {t}" for n, t in zip(measures, types)))
    rows = materialize(rows, "quality")
    given = labels.select("doc_id", "label").dropna().groupBy("doc_id").agg(F.mode("label", True).alias("label"))
    sample = rows.join(given, "doc_id").select("label", F.col("body_language").alias("language"), "features", "size", F.xxhash64("doc_id").alias("h")).orderBy("h", "features").limit(SAMPLE).toPandas()
    filled = sample[sample["size"] > 0]
    prose = fit_prose(filled) if len(filled) else {}
    model = spark.sparkContext.broadcast((prose, fit_kinds(sample, prose)))

    def judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prose, references = model.value
        for b in batches:
            x = np.array(b["features"].tolist(), dtype=np.float64).reshape(-1, len(STATISTICS))
            far, parts = np.zeros(len(b)), np.zeros_like(x)
            beyond = (b["size"] == 0).to_numpy()
            for name in b["body_language"].unique() if prose else ():
                own = (b["body_language"] == name).to_numpy()
                center, inverse, cutoff = prose.get(name) or prose[""]
                diff = x[own] - center
                parts[own] = diff * (diff @ inverse)
                far[own] = parts[own].sum(axis=1)
                beyond[own] |= far[own] > cutoff
            verdict = np.full(len(b), "prose", dtype=object)
            verdict[beyond] = kinds_of(x[beyond], references)
            shown = x[:, [STATISTICS.index(n) for n in ("letter_share", "digit_share", "symbol_share")]].sum(axis=1) > 0
            verdict[~shown & beyond] = "junk"  # blank, or nothing but usual punctuation
            share = parts / np.where(far > 0, far, 1.0)[:, None]
            stats = [pd.DataFrame(np.array(b[c].tolist(), dtype=np.float64).reshape(-1, len(STATISTICS)), columns=[lead + n for n in STATISTICS]) for c, lead in (("stats", ""), ("body", "body_"))]
            head = pd.DataFrame({"doc_id": b["doc_id"].to_numpy(), "language": b["language"].replace({"": None}).to_numpy(), "words": b["words"].to_numpy()})
            tail = pd.DataFrame({"distance": far, "contributions": [dict(zip(STATISTICS, row)) for row in share.tolist()], "verdict": verdict})
            yield pd.concat([head, *stats, tail], axis=1)

    names = ["doc_id", "language", "words", *STATISTICS, *(f"body_{n}" for n in STATISTICS), "distance", "contributions", "verdict"]
    types = [*types[:3], *["double"] * (2 * len(STATISTICS)), "double", "map<string,double>", "string"]
    return rows.mapInPandas(judged, ", ".join(f"{n} {t}" for n, t in zip(names, types)))
