"""WordPiece tokens, windows and batches for an embedding model."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blocks of Chinese characters.
_CHINESE = ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F))
_ASCII_MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def basic_tokens(text: str) -> list[str]:
    """Words and single punctuation marks in lower case without accents; Chinese characters stand alone."""
    spaced = []
    for ch in text:
        category = unicodedata.category(ch)
        if ch in "\t\n\r" or category[0] == "Z":
            spaced.append(" ")
        elif ch in "\0�" or category in ("Cc", "Cf"):
            continue
        else:
            spaced.append(f" {ch} " if any(a <= ord(ch) <= b for a, b in _CHINESE) else ch)
    plain = "".join(c for c in unicodedata.normalize("NFD", "".join(spaced).lower()) if unicodedata.category(c)[0] != "M")
    return "".join(f" {c} " if c in _ASCII_MARKS or unicodedata.category(c)[0] == "P" else c for c in plain).split()


@dataclass
class WordPiece:
    """A WordPiece vocabulary; ``definition`` is the parsed JSON of a tokenizer file."""

    vocab: dict[str, int]
    prefix: str = "##"
    most_chars: int = 100
    max_length: int = 512
    unk: str = "[UNK]"

    @classmethod
    def load(cls, definition: dict) -> WordPiece:
        model = definition.get("model") or {}
        vocab = model.get("vocab")
        if model.get("type") != "WordPiece" or not isinstance(vocab, dict):
            raise ValueError("not a WordPiece definition")
        made = cls(vocab, model.get("continuing_subword_prefix", "##"), model.get("max_input_chars_per_word", 100), (definition.get("truncation") or {}).get("max_length", 512), model.get("unk_token", "[UNK]"))
        for token in (made.unk, "[CLS]", "[SEP]", "[PAD]"):
            if token not in vocab:
                raise ValueError(f"the vocabulary lacks {token}")
        return made

    def pieces(self, word: str) -> list[int]:
        """Greedy longest pieces; one unknown id when the word is too long or cannot be cut."""
        out: list[int] = []
        rest = word
        while rest and len(word) <= self.most_chars:
            lead = self.prefix if out else ""
            size = next((n for n in range(len(rest), 0, -1) if lead + rest[:n] in self.vocab), 0)
            if not size:
                break
            out.append(self.vocab[lead + rest[:size]])
            rest = rest[size:]
        return [self.vocab[self.unk]] if rest else out

    def ids(self, text: str) -> list[int]:
        return [i for word in basic_tokens(text) for i in self.pieces(word)]

    def encode(self, text: str) -> list[int]:
        return [self.vocab["[CLS]"], *self.ids(text)[: self.max_length - 2], self.vocab["[SEP]"]]


def token_ids(df: DataFrame, model: WordPiece, text: str, out: str = "ids") -> DataFrame:
    """Add the token ids of a text column; null has none."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<bigint>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [] if t is None else shared.value.ids(t))

    return df.withColumn(out, run(text))


def windows(ids: Column, width: int, first: int, last: int, most: int | None) -> Column:
    """array<array<bigint>>: windows of ``width`` ids side by side, at most ``most`` (all with None), each between ``first`` and ``last``; one empty window without ids."""
    starts = F.when(F.size(ids) > 0, F.slice(F.sequence(F.lit(1), F.size(ids), F.lit(width)), 1, most or 2**31 - 1)).otherwise(F.array(F.lit(1)))
    return F.transform(starts, lambda at: F.concat(F.array(F.lit(first).cast("bigint")), F.slice(ids, at, width), F.array(F.lit(last).cast("bigint"))))


def padded(sequences: list[list[int]], pad: int) -> dict[str, np.ndarray]:
    """Input ids, attention mask and zero type ids of a batch, all [batch, longest]."""
    if not sequences or not all(len(s) for s in sequences):
        raise ValueError("a batch needs sequences with ids")
    shape = (len(sequences), max(map(len, sequences)))
    ids, mask = np.full(shape, pad, np.int64), np.zeros(shape, np.int64)
    for row, s in enumerate(sequences):
        ids[row, : len(s)] = s
        mask[row, : len(s)] = 1
    return {"input_ids": ids, "attention_mask": mask, "token_type_ids": np.zeros(shape, np.int64)}
