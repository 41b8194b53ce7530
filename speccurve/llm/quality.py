"""Document quality by weak supervision: rules vote, EM weighs them."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speccurve.llm.common import map_texts, stored

# Frequent short words of four languages.
STOP_WORDS = (
    "the of and to a in is that for with "
    "der die und den von das mit ist ein nicht "
    "de la le et les des que un une dans "
    "el los en las y por con para se del"
).split()

# name: value of a document; good and bad: from where on the rule votes so.
# A rule abstains between them and where its value is null.
# Low values are good, or high ones where good > bad.
RULES = (
    ("symbols", "n_symbols / nullif(n_words, 0)", 0.05, 0.15),
    ("capitals", "n_upper / nullif(n_letters, 0)", 0.20, 0.50),
    ("exclamations", "n_exclamations / nullif(n_words, 0)", 0.10, 0.40),
    ("repeated_words", "n_repeat_words / nullif(n_words, 0)", 0.25, 0.45),
    ("repeated_lines", "IF(n_lines > 2, n_dup_lines / n_lines, NULL)", 0.20, 0.40),
    ("long_words", "word_chars / nullif(n_words, 0)", 6.5, 7.8),
    ("letter_words", "n_letter_words / nullif(n_words, 0)", 0.85, 0.65),
    ("stop_words", "n_stop_words / nullif(n_words, 0)", 0.06, 0.01),
    ("line_ends", "IF(n_lines > 2, n_ended_lines / n_lines, NULL)", 0.60, 0.25),
)

FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
    "n_ended_lines", "n_letters", "n_upper", "n_exclamations", "n_letter_words", "n_stop_words",
)
ROUNDS = 200

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_LETTER = re.compile(r"[^\W\d_]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-ÞĀ-ɏΑ-ΩА-Я]")
_ENDED = re.compile(r"[.!?:;…。！？][\"'”’»)\]]*$")


def repeated_words(words: list[str]) -> int:
    """Words inside some run of three that occurs at least twice in ``words``."""
    if len(words) < 4:
        return 0
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    pair = ids[:-1] * len(known) + ids[1:]
    if len(known) > 1_000_000:  # else three ids fit into 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    run = pair[:-1] * len(known) + ids[2:]
    order = np.argsort(run, kind="stable")
    same = run[order][1:] == run[order][:-1]
    twice = np.zeros(len(words), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    starts = twice.copy()
    twice[1:] |= starts[:-1]
    twice[2:] |= starts[:-2]
    return int(twice.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """FEATURES of one text; a null text has no words."""
    text = text or ""
    words = _WORD.findall(text)
    seen: set[str] = set()
    n_dup = n_lines = n_ended = 0
    for line in text.split("\n"):
        if _WORD.search(line):
            n_lines += 1
            n_dup += line in seen
            seen.add(line)
            n_ended += _ENDED.search(line.rstrip()) is not None
    stop = _STOP
    return (
        len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), n_dup,
        repeated_words(words), n_lines, n_ended, len(_LETTER.findall(text)),
        len(_UPPER.findall(text)), text.count("!"),
        sum(1 for w in words if _LETTER.search(w)),
        sum(1 for w in words if w.strip(".,;:!?").lower() in stop),
    )


_STOP = frozenset(STOP_WORDS)


def features(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and FEATURES of every document, from its whole text."""

    def start():
        def work(columns):
            rows = np.array([measure(x) for x in columns[1].to_pylist()], np.int64)
            rows = rows.reshape(-1, len(FEATURES))
            return [columns[0], *[pa.array(rows[:, k]) for k in range(len(FEATURES))]]

        return work

    key_type = df.schema[key].dataType.simpleString()
    schema = ", ".join([f"{key} {key_type}", *[f"{name} long" for name in FEATURES]])
    return map_texts(df, [key, text], schema, start)


def vote(value: str, good: float, bad: float) -> Column:
    """1 for good, 2 for bad, 0 to abstain."""
    x = F.expr(value)
    is_good, is_bad = (x <= good, x >= bad) if good < bad else (x >= good, x <= bad)
    return F.when(is_good, 1).when(is_bad, 2).otherwise(0)


def fit(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents and, per rule, how often a vote cast on a good
    (bad) document says good (bad), by expectation-maximisation.

    Votes are taken as independent given the class, and abstaining as saying
    nothing about it.  One good and one bad vote are added to each count.
    """
    prior, right = 0.8, np.full((2, patterns.shape[1]), 0.8)
    for _ in range(ROUNDS):
        good = posterior(patterns, prior, right)
        before = np.r_[prior, right.ravel()]
        prior = float((counts @ good + 1) / (counts.sum() + 2))
        for k, (weight, said) in enumerate(((counts * good, 1), (counts * (1 - good), 2))):
            cast = weight @ (patterns > 0)
            right[k] = (weight @ (patterns == said) + 1) / (cast + 2)
        if np.abs(np.r_[prior, right.ravel()] - before).max() < 1e-10:
            break
    return prior, right[0], right[1]


def posterior(patterns: np.ndarray, prior: float, right: np.ndarray) -> np.ndarray:
    """Probability that a document with these votes is good."""
    said_good, said_bad = patterns == 1, patterns == 2
    log_good = np.log(prior) + said_good @ np.log(right[0]) + said_bad @ np.log1p(-right[0])
    log_bad = np.log1p(-prior) + said_good @ np.log1p(-right[1]) + said_bad @ np.log(right[1])
    return 1 / (1 + np.exp(np.clip(log_bad - log_good, -700, 700)))


def base_failed() -> Column:
    """Too short, or mostly repetition: no case for a vote."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, FEATURES, base_failed, votes, and ``quality``: the posterior
    probability of good.

    All documents that pass the base take part in the estimate; those that fail
    it are bad already, and with them the second class would be theirs.  The
    driver gets one count per combination of votes, 3 to the number of RULES at
    most, and the same table goes back.  A null text counts as an empty one;
    without words all rules abstain and the quality is the prior.  An empty
    table gives no rows; repeated rows are judged alike.  Columns other than
    key and text are ignored.
    """
    base = 3
    code = F.lit(0)
    for _, value, good, bad in RULES:
        code = code * base + vote(value, good, bad)
    voted = features(df, key, text).withColumns({"base_failed": base_failed(), "votes": code})
    voted = stored(voted, "quality")
    found = (
        voted.groupBy("votes")
        .agg(F.count_if(~F.col("base_failed")).alias("count"))
        .collect()
    )
    codes = np.array([r["votes"] for r in found], np.int64)
    counts = np.array([r["count"] for r in found], float)
    powers = base ** np.arange(len(RULES) - 1, -1, -1)
    patterns = codes.reshape(-1, 1) // powers % base
    prior, good, bad = fit(patterns, counts)
    table = df.sparkSession.createDataFrame(
        [
            (int(c), float(p))
            for c, p in zip(codes, posterior(patterns, prior, np.array([good, bad])), strict=True)
        ],
        "votes int, quality double",
    )
    return voted.join(F.broadcast(table), "votes")
