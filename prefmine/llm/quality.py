"""Quality rules, line first.

Every line is judged by punctuation, navigation and boilerplate rules; failing
lines are removed; a document that loses too much of its words, or that fails
the base rules on its whole text, is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefmine.llm.common import WORD, free_name

WORDS = re.compile(WORD)
SYMBOLS = "#*$%&|<>"
# What a sentence may end with; closing quotes, brackets and blanks after it are aside.
TERMINALS, CLOSERS, BLANKS = ".!?…:;。！？；：؟।॥", "'\"”’»)]}`", " \t\r\x0b\x0c"
# A sentence that ends inside the line: the line is prose that breaks off.
SENTENCE = re.compile(r"""\w[.!?…][’'"”»)]*\s+\w|[。！？।]""")
SEPARATORS = re.compile(r" [|»›·•/>] | :: |^\s*[|»›·•]|[|»›·•]\s*$")
NAVIGATION = re.compile(r"^\W*(?:home|menu|login|log in|sign in|sign up|register|subscribe|search|next|previous|prev|"
                        r"back to top|read more|click here|share(?: this)?|contact(?: us)?|about(?: us)?|skip to content)"
                        r"(?:\W+(?:home|menu|login|sign in|sign up|register|search|contact|about|next|previous))*\W*$", re.I)
# In English, German, French and Spanish.
BOILERPLATE = re.compile(r"lorem ipsum|\bjavascript\b|\bcookies?\b.{0,40}\b(?:policy|consent|accept|settings)\b|"
                         r"\b(?:accept|use|uses|verwende[nt]?|nutzen|akzeptieren|utilisons|utilise|acceptez|utilizamos|utiliza|usamos|aceptar)\b.{0,20}\bcookies\b|"
                         r"terms of (?:use|service)|privacy policy|datenschutzerklärung|politique de confidentialité|política de privacidad|"
                         r"all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|"
                         r"copyright (?:©|\(c\))|\b(?:licensed|released|published) under (?:the|a|an|cc|mit|gpl|apache|bsd|lgpl|mpl|creative commons)\b|"
                         r"lizenziert unter|sous licence|bajo (?:la )?licencia|powered by \w+", re.I)
# What a line in lower case must hold for BOILERPLATE to find anything: far quicker to look for.
STEMS = ("lorem", "javascript", "cookie", "terms of ", "policy", "datenschutz", "confidentialit", "privacidad", "reserved", "vorbehalten",
         "droits r", "derechos", "copyright", "under ", "lizenziert", "licence", "licencia", "powered by")
# A sentence of a line: up to its end marks.
PART = re.compile(r"[^.!?]+[.!?]*")


@dataclass(frozen=True)
class Rules:
    """Thresholds, as shares.  A line of words fails if its symbols exceed
    ``symbols`` of its words, or exclamations beyond one exceed ``shouts`` of its
    words (punctuation), or if boilerplate sentences hold ``boilerplate`` or more of its
    words; a document is rejected if removed lines held more than
    ``lost`` of its words.  ``min_words`` and ``repeats`` are the base rules."""

    symbols: float = 0.2
    shouts: float = 0.5
    lost: float = 0.4
    boilerplate: float = 0.5
    min_words: int = 10
    repeats: float = 0.2


def line_fails(line: str, n_words: int, rules: Rules) -> str | None:
    """The rule that the line breaks: punctuation, navigation or boilerplate."""
    if len(SEPARATORS.findall(line)) > max(1, n_words // 8) or NAVIGATION.match(line):
        return "navigation"
    if sum(map(line.count, SYMBOLS)) > rules.symbols * n_words or line.count("!") > 1 + rules.shouts * n_words:
        return "punctuation"
    low = line.lower()
    if any(s in low for s in STEMS) and BOILERPLATE.search(line) and sum(len(WORDS.findall(p)) for p in PART.findall(line) if BOILERPLATE.search(p)) >= rules.boilerplate * n_words:
        return "boilerplate"
    end = line.rstrip(BLANKS).rstrip(CLOSERS)
    if not (end and end[-1] in TERMINALS) and SENTENCE.search(line) is None:
        return "punctuation"
    return None


def repeated_words(ids: np.ndarray, distinct: int, n: int = 5) -> int:
    """Positions covered by windows of ``n`` ids that occur at least twice."""
    if len(ids) < n:
        return 0
    last = len(ids) - n + 1
    windows, span = ids[:last], distinct
    for i in range(1, n):
        if span * distinct >= 1 << 62:  # renumber before the codes overflow
            windows = np.unique(windows, return_inverse=True)[1].reshape(-1)
            span = last
        windows = windows * distinct + ids[i : last + i]
        span *= distinct
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(windows), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return int((np.cumsum(edge) > 0).sum())


def judge(text: str | None, rules: Rules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words,
    kept text).  Works line by line: only one line's words are held as strings."""
    text = text or ""
    codes: dict[bytes, int] = {}
    ids, seen, kept = [], set(), []
    n_words = chars = dup = lost = 0
    for line in text.split("\n"):
        words = line.encode("utf-8", "surrogatepass").split()
        if not words:
            kept.append(line)
            continue
        n_words += len(words)
        chars += len(line) - sum(map(line.count, " \t\r\x0b\x0c"))
        dup += line in seen
        seen.add(line)
        ids.append(np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, len(words)))
        if line_fails(line, len(words), rules):
            lost += len(words)
        else:
            kept.append(line)
    repeat = repeated_words(np.concatenate(ids), len(codes)) if ids else 0
    return n_words, chars, sum(map(text.count, SYMBOLS)), dup, repeat, lost, "\n".join(kept)


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "lost_words long, base_failed boolean, kept boolean")


def line_first_quality(docs: DataFrame, text: str = "text", rules: Rules = Rules(),
                       clean: str | None = None) -> DataFrame:
    """``docs`` with the columns of ``SCHEMA`` (replacing columns of these names)
    and, if ``clean`` names a column, the text without its failing lines.

    Lines are what ``\\n`` separates; a line without a word is never judged.  A
    null or empty text has no words, fails the base rules and is not kept.
    Repeated rows are judged alike.  Only the text passes through Python.
    """
    schema = SCHEMA + (", cleaned string" if clean else "")

    @F.pandas_udf(schema)
    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = []
            for t in s:
                n, chars, symbols, dup, repeat, lost, rest = judge(t if isinstance(t, str) else None, rules)
                base = n < rules.min_words or repeat > rules.repeats * n
                row = (n, chars, symbols, dup, repeat, lost, base, not base and lost <= rules.lost * n)
                rows.append((*row, rest) if clean else row)
            names = [c.split()[0] for c in schema.split(", ")]
            yield pd.DataFrame(rows, columns=names)

    # Declared nondeterministic so that a later filter on the verdict is not pushed
    # below it, which would judge every text twice.
    tmp = free_name(docs.columns, "quality_")
    out = docs.withColumn(tmp, verdicts.asNondeterministic()(F.col(text)))
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    drop = [c for c in docs.columns if c.lower() in {*names, *([clean.lower()] if clean else [])}]
    cols = [F.col(c) for c in docs.columns if c not in drop]
    return out.select(*cols, *[F.col(f"{tmp}.{c}").alias(c) for c in names],
                      *([F.col(f"{tmp}.cleaned").alias(clean)] if clean else []))
