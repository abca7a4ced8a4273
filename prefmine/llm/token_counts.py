"""Token counts: a map-side lookup in two tiers.

A pre-token is what the tokenizer's pre-tokenizer cuts a text into; its merges
never cross a pre-token, so a text's token count is the sum of its pre-tokens'
lengths.  Tier one is a broadcast table of the lengths of frequent pre-tokens,
tier two a bounded cache in every Python worker that encodes what tier one
misses.  Both are only caches of the tokenizer's own answers, so the counts do
not depend on what they hold, and no pre-token of the corpus is ever shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmine.llm.common import free_name, pieces

# Texts made only of these characters are cut by FAST, with which the library's
# normalizer and pre-tokenizer agree: composed letters whose lower case is one
# character, ASCII digits, ASCII white space.  Any other piece of text goes
# through the library's own normalizer and pre-tokenizer.
ODD = re.compile("[^\x00-\x7fÀ-ÖØ-öø-įı-ž]")
FAST = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ž]+|[0-9]|[^\t-\r a-z0-9ß-öø-ž]+")


class Lengths(dict):
    """Pre-token -> number of tokens; encodes on a miss, in two generations of
    at most ``limit`` entries so memory stays bounded."""

    def __init__(self, tokenizer, frequent: dict[str, int], limit: int = 1 << 19):
        super().__init__(frequent)
        self.tokenizer, self.frequent, self.limit, self.old = tokenizer, frequent, limit, {}

    def __missing__(self, word: str) -> int:
        n = self.old.get(word)
        if n is None:
            n = len(self.tokenizer.encode(word, add_special_tokens=False).ids)
        if len(word) <= 64:  # a long pre-token hardly comes again
            if len(self) >= self.limit + len(self.frequent):
                self.old = dict(self)
                self.clear()
                self.update(self.frequent)
            self[word] = n
        return n


class TextCounter:
    """Counts one text's tokens as the library does with its defaults: special
    strings in the text count one token each, nothing is added or truncated."""

    def __init__(self, path: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or r"(?!)")
        self.lengths = Lengths(self.tokenizer, frequent)

    def pre_tokens(self, piece: str) -> list[str]:
        if ODD.search(piece) is None:
            return FAST.findall(piece.lower())
        normal = self.tokenizer.normalizer.normalize_str(piece)
        # The byte-level step renames bytes; the offsets give the characters.
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def count(self, text: str) -> int:
        look, n, at = self.lengths.__getitem__, 0, 0
        spans = [m.span() for m in self.special.finditer(text)] if "<|" in text else []
        for a, b in [*spans, (len(text), None)]:
            for piece in pieces(text[at:a]):
                n += sum(map(look, self.pre_tokens(piece)))
            at = b
        return n + len(spans)


_counters: dict[tuple, TextCounter] = {}


def _counter(path: str, table: tuple[str, bytes]) -> TextCounter:
    """One per worker and tokenizer: its cache outlives the task."""
    words, lengths = table
    key = (path, hash(words))
    if key not in _counters:
        _counters.clear()
        _counters[key] = TextCounter(path, dict(zip(words.split("\n"), lengths)) if words else {})
    return _counters[key]


def frequent_pre_tokens(docs: DataFrame, path: str, text: str = "text", sample_docs: int = 2000,
                        table_size: int = 1 << 15):
    """Tier one as a Spark broadcast: the ``table_size`` most frequent pre-tokens
    of a Bernoulli sample of about ``sample_docs`` rows, each with its length.

    Both bounds are parameters; the sample only decides which lengths are known
    beforehand, never a count.  The table is two flat strings (pre-tokens of at
    most 64 characters and one byte each), under ``table_size`` * 260 bytes.
    """
    n = docs.count()
    sample = docs.select(F.col(text).alias("t")).where(F.col("t").isNotNull())
    sample = sample.sample(min(1.0, sample_docs / n) if n else 1.0, seed=0)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(path, ("", b""))
        for b in batches:
            seen: Counter = Counter()
            for t in b["t"]:
                for p in pieces(t):
                    seen.update(w for w in counter.pre_tokens(p) if len(w) <= 64)
            yield pd.DataFrame({"w": list(seen), "n": list(seen.values())})

    top = (sample.mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "w").limit(table_size).collect())
    counter = TextCounter(path, {})
    words = [r.w for r in top if r.n > 1 and "\n" not in r.w]
    lengths = [counter.lengths[w] for w in words]
    kept = [(w, k) for w, k in zip(words, lengths) if k < 256]
    table = ("\n".join(w for w, _ in kept), bytes(k for _, k in kept))
    return docs.sparkSession.sparkContext.broadcast(table)


def count_tokens(docs: DataFrame, path: str, text: str = "text", name: str = "n_tokens",
                 sample_docs: int = 2000, table_size: int = 1 << 15) -> DataFrame:
    """``docs`` with ``name``: the tokens of the whole text under the tokenizer
    file ``path`` (a path every executor has).

    A null or empty text has 0 tokens.  Repeated rows are counted row by row.
    Texts of any length are cut at white space into pieces, so only a piece's
    pre-tokens are in memory at once.  A column called ``name`` is replaced;
    every other column is passed through outside Python.
    """
    frequent = frequent_pre_tokens(docs, path, text, sample_docs, table_size)

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path, frequent.value)
        for s in batches:
            yield pd.Series([0 if not isinstance(t, str) else counter.count(t) for t in s], dtype="int64")

    tmp = free_name(docs.columns, "counted_")
    out = docs.withColumn(tmp, tokens(F.col(text)))
    return out.drop(name).withColumnRenamed(tmp, name)
