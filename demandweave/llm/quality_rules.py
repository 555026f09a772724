"""Quality by weak supervision: rules vote or abstain, expectation-maximisation says what a vote is worth.

Each rule looks at the counts of a text and votes good, bad, or not at all. No labels are read: how often a
rule votes either way among good and among bad documents is estimated over all documents, by
expectation-maximisation on the number of documents per vote pattern. There are at most 3 ** len(RULES)
patterns whatever the corpus, so that table alone reaches the driver. A document stays if its posterior
probability of being good is at least 0.5 and it has not failed the base rules.

Defined cases: null or empty text has no words, fails the base rules and is not kept. Texts are read whole.
Equal rows get equal results. An empty table gives an empty one. Other columns pass through; a column that
bears an output's name is replaced. The id is never looked at, so it may be null or repeated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import SPACES, byte_table, flat_words, in_batches, small_batches, text_buffer, with_columns

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 3
#: Base rules: fewer words, or a larger share (in hundredths) of words in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: A rule's score, the limits beyond which it votes (good at or below the first, bad from the second on;
#: between them it abstains), and whether what it finds is a kind of fault of its own, or supports others.
RULES = (
    ("symbols_per_word", 0.02, 0.15, True),
    ("repeated_words", 0.05, 0.30, True),
    ("repeated_lines", 0.05, 0.50, False),
    ("upper_share", 0.15, 0.40, True),
    ("exclamations_per_word", 0.05, 0.30, True),
    ("words_without_letter", 0.08, 0.25, True),
    ("word_length_off", 2.5, 5.0, False),
    ("lines_without_end", 0.60, 0.95, False),
)
#: What is taken as known before any document is seen, and what share of the documents it weighs.
PRIOR_GOOD, FALSE_ALARM, OWN_FAULT, OTHER_FAULT, PRIOR_WEIGHT = 0.8, 0.005, 0.95, 0.1, 0.1
TYPICAL_WORD = 6.0


def _mask(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_SPACE, _SYMBOL, _STOP = _mask(SPACES), _mask(b"#*$%&|<>"), _mask(b".!?:;\"'")
_UPPER = _mask(bytes(range(65, 91)))
_LETTER = _UPPER | _mask(bytes(range(97, 123))) | _mask(bytes(range(0xC3, 256)))
_FIRST = ~_mask(bytes(range(0x80, 0xC0)))


def _repeated_words(codes: np.ndarray, base: int) -> int:
    """Words inside 3-word windows that occur twice or more among a document's words."""
    if len(codes) <= WINDOW:
        return 0
    if base >= 1 << 21:  # three codes would not fit in 64 bits
        codes = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        base = int(codes.max()) + 1
    keys = (codes[:-2] * base + codes[1:-1]) * base + codes[2:]
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(keys) + 2, bool)
    at = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    for j in range(WINDOW):
        twice[at + j] = True
    return int(twice.sum())


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a column, and the rules' scores."""
    data, ends = text_buffer(column)

    def per_row(mask):
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[ends[1:]] - total[ends[:-1]]

    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True  # a new row begins a new word
    begins = word & (edge[:-1] | np.concatenate([[True], ~word[:-1]]))
    starts = np.flatnonzero(begins)
    lettered = np.zeros(len(data), bool)
    if len(starts):
        lettered[starts] = np.add.reduceat(_LETTER[data].astype(np.int32), starts) > 0
    out = {
        "n_words": per_row(begins),
        "word_chars": per_row(word & _FIRST[data]),
        "n_symbols": per_row(_SYMBOL[data]),
    }
    flat, offsets = flat_words(column, byte_table())
    codes = flat.dictionary_encode()
    base, codes = len(codes.dictionary), codes.indices.to_numpy().astype(np.int64)
    repeated, double, lines, ended = (np.zeros(len(column), np.int64) for _ in range(4))
    blanks = SPACES.decode()
    for i, text in enumerate(column.to_pylist()):
        repeated[i] = _repeated_words(codes[offsets[i] : offsets[i + 1]], base)
        full = [s for s in (text or "").split("\n") if s.strip(blanks)]
        lines[i], double[i] = len(full), len(full) - len(set(full))
        ended[i] = sum(s.rstrip(blanks)[-1] in ".!?:;\"'" for s in full)
    out |= {"n_dup_lines": double, "n_repeat_words": repeated}
    n, letters = np.maximum(out["n_words"], 1), np.maximum(per_row(_LETTER[data]), 1)
    scores = np.stack(
        [
            out["n_symbols"] / n,
            repeated / n,
            double / np.maximum(lines, 1),
            per_row(_UPPER[data]) / letters,
            per_row(data == 33) / n,
            1 - per_row(lettered) / n,
            np.abs(out["word_chars"] / n - TYPICAL_WORD),
            1 - ended / np.maximum(lines, 1),
        ]
    )
    votes = np.zeros(len(column), np.int64)
    for score, (_, good, bad, _) in zip(scores, RULES, strict=True):
        votes = votes * 3 + np.where(score >= bad, 2, np.where(score <= good, 1, 0))
    return out | {"votes": votes}


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with COUNTS (long) and ``votes`` (long): a base-3 number with a digit per rule, 0 abstains,
    1 good, 2 bad."""

    def run(batches):
        for batch in small_batches(batches, text):
            found = text_counts(batch.column(text))
            yield with_columns(batch, **{k: pa.array(v, pa.int64()) for k, v in found.items()})

    names = (*COUNTS, "votes")
    docs = docs.drop(*names).withColumns({c: F.lit(0).cast("long") for c in names})
    return in_batches(docs, run, docs.schema)


def digits(votes: np.ndarray) -> np.ndarray:
    """A row per pattern, a column per rule."""
    m = len(RULES)
    return votes[:, None] // 3 ** np.arange(m - 1, -1, -1)[None, :] % 3


def fit(votes: np.ndarray, weight: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Posterior probability of good per vote pattern; ``weight`` is the documents of each pattern.

    Bad documents are bad in different ways, so there is one good class and one class per kind of fault.
    Each class has its own probability of a bad vote per rule (an abstention tells nothing), re-estimated
    from all documents in each round, the prior weighing as much as PRIOR_WEIGHT of them.
    """
    cast = digits(votes)
    bad, good = (cast == 2).astype(float), (cast == 1).astype(float)
    kinds = [r for r, rule in enumerate(RULES) if rule[3]]
    guess = np.full((1 + len(kinds), len(RULES)), OTHER_FAULT)
    guess[0] = FALSE_ALARM
    guess[range(1, len(guess)), kinds] = OWN_FAULT
    share = np.array([PRIOR_GOOD] + [(1 - PRIOR_GOOD) / len(kinds)] * len(kinds))
    pseudo = PRIOR_WEIGHT * weight.sum() * share
    chance, mix, belief = guess, share, None
    for _ in range(rounds):
        log = np.log(mix)[:, None] + np.log(chance) @ bad.T + np.log1p(-chance) @ good.T
        new = np.exp(log - log.max(0))
        new /= new.sum(0)
        if belief is not None and np.abs(new - belief).max() < 1e-9:
            break
        belief = new
        mass = weight * belief
        mix = (mass.sum(1) + pseudo) / (weight.sum() * (1 + PRIOR_WEIGHT))
        told = mass @ (bad + good) + pseudo[:, None]
        chance = np.clip((mass @ bad + pseudo[:, None] * guess) / told, 1e-6, 1 - 1e-6)
    return belief[0]


def judged(counted: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """``counted`` with ``base_failed``, ``quality`` (posterior) and ``kept``. The vote table comes from
    ``patterns`` (default: ``counted`` itself)."""
    rows = (counted if patterns is None else patterns).groupBy("votes").count().orderBy("votes").collect()
    votes = np.array([r["votes"] for r in rows], np.int64)
    belief = fit(votes, np.array([r["count"] for r in rows], float)) if rows else np.empty(0)
    table = counted.sparkSession.createDataFrame(
        list(zip(votes.tolist(), belief.tolist())), "votes long, quality double"
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        counted.drop("quality", "base_failed", "kept")
        .join(F.broadcast(table), "votes", "left")
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("quality") >= 0.5))
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that the rules keep, with the columns they came with."""
    return judged(with_counts(docs, text)).filter("kept").select(*docs.columns)
