"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them. DataFrame functions only.

Each rule votes 1 (good), -1 (bad) or 0 (abstains). A document's class is hidden. How often each rule votes how in each class,
and so its accuracy, is estimated from how rules agree over all documents: documents are counted by vote pattern
(3 ** rules patterns at most), and each EM step is one aggregate over that small table. A document is kept if it passes the base
limits and its posterior probability of being good is at least 0.5.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, materialize

P = "__q_"  # internal columns, so that none of the input's clash


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """How many words stand in a three-word window that the array holds twice or more."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.xxhash64(words[i], words[i + 1], words[i + 2]).alias("h"), i.alias("p")))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
        first = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(starts, first, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")), lambda a: a["n"])

    return F.when(F.size(words) >= 3, let(F.sort_array(windows), covered)).otherwise(0)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with what the rules look at."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    size = lambda c: F.length(c).cast("long")
    return docs.withColumns({
        f"{P}arrays": F.struct(words.alias("words"), lines.alias("lines")),
        f"{P}word_chars": size(F.regexp_replace(text, SPACE, "")),
        f"{P}n_symbols": size(F.regexp_replace(text, r"[^#*$%&|<>]+", "")),
        f"{P}n_upper": size(F.regexp_replace(text, r"\P{Lu}+", "")),
        f"{P}n_cries": size(text) - size(F.replace(text, F.lit("!"), F.lit(""))),
    }).withColumns({
        f"{P}n_words": F.size(f"{P}arrays.words").cast("long"),
        f"{P}n_lines": F.size(f"{P}arrays.lines").cast("long"),
        f"{P}n_dup_lines": (F.size(f"{P}arrays.lines") - F.size(F.array_distinct(f"{P}arrays.lines"))).cast("long"),
        f"{P}n_repeat_words": let(F.col(f"{P}arrays.words"), repeat_words).cast("long"),
    }).drop(f"{P}arrays")


def _share(top: str, bottom: str) -> Column:
    return F.col(P + top) / F.greatest(F.col(P + bottom), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """Votes bad where a condition holds, good where another does, else abstains."""

    name: str
    bad: Callable[[], Column] | None = None
    good: Callable[[], Column] | None = None

    def vote(self) -> Column:
        out = F.when(self.bad(), -1) if self.bad else F.when(F.lit(False), 0)
        return (out.when(self.good(), 1) if self.good else out).otherwise(0)


def _prose() -> Column:
    # not far below where other rules call a text bad: a text in between would look bad just for lack of this vote
    tame = [_share("n_symbols", "n_words") <= 0.2, _share("n_upper", "word_chars") <= 0.25, _share("n_cries", "n_words") <= 0.15, _share("n_repeat_words", "n_words") <= 0.4]
    out = _share("word_chars", "n_words").between(3, 11)
    for x in tame:
        out = out & x
    return out


RULES = (
    Rule("symbols", bad=lambda: _share("n_symbols", "n_words") >= 0.3),
    Rule("capitals", bad=lambda: _share("n_upper", "word_chars") >= 0.3),
    Rule("cries", bad=lambda: _share("n_cries", "n_words") >= 0.2),
    Rule("repeats", bad=lambda: _share("n_repeat_words", "n_words") >= 0.4),
    Rule("dup_lines", bad=lambda: _share("n_dup_lines", "n_lines") >= 0.4),
    Rule("word_length", bad=lambda: ~_share("word_chars", "n_words").between(2, 14)),
    Rule("length", bad=lambda: F.col(f"{P}n_words") < 50, good=lambda: F.col(f"{P}n_words") >= 200),
    Rule("prose", good=_prose),
)
VOTES = (-1, 0, 1)
# Where EM starts: how often a rule votes -1, 0 and 1 on bad and on good documents, if it can vote that way.
START = {"bad": (0.3, 0.6, 0.1), "good": (0.03, 0.37, 0.6)}


@dataclass
class Weights:
    """What EM has found: the share of good documents, and for each rule and class how often it votes -1, 0 and 1."""

    prior: float = 0.8
    given: dict[str, list[tuple[float, ...]]] = field(default_factory=lambda: {c: [v] * len(RULES) for c, v in START.items()})
    rounds: int = 0

    def posterior(self) -> Column:
        """Probability of good, given the vote columns."""
        odds = F.lit(log(self.prior / (1 - self.prior)))
        for k in range(len(RULES)):
            gain = [F.lit(log(g / b)) for g, b in zip(self.given["good"][k], self.given["bad"][k], strict=True)]
            vote = F.col(f"{P}v{k}")
            odds = odds + F.when(vote == -1, gain[0]).when(vote == 0, gain[1]).otherwise(gain[2])
        return 1 / (1 + F.exp(-odds))

    def accuracy(self) -> list[float]:
        """Of each rule: how often it is right where it votes."""
        out = []
        for g, b in zip(self.given["good"], self.given["bad"], strict=True):
            right, wrong = self.prior * g[2] + (1 - self.prior) * b[0], self.prior * g[0] + (1 - self.prior) * b[2]
            out.append(right / (right + wrong))
        return out


def votes(measured: DataFrame) -> DataFrame:
    return measured.withColumns({f"{P}v{k}": r.vote() for k, r in enumerate(RULES)})


def fit(voted: DataFrame, rounds: int = 30, tolerance: float = 1e-4, smoothing: float = 0.01) -> Weights:
    """EM over the table of vote patterns, with the given share of the starting frequencies mixed in at each step.

    A bad vote stays at least as frequent among bad documents as among good ones, and a good vote among good ones, so the
    classes can't swap. The prior stays within 0.05 and 0.99. A table without rows leaves the starting weights.
    """
    names = [f"{P}v{k}" for k in range(len(RULES))]
    patterns = materialize(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")), "votes")
    w = Weights()
    for w.rounds in range(1, rounds + 1):  # noqa: B007
        p = w.posterior()
        mass = {"good": F.col("n") * p, "bad": F.col("n") * (1 - p)}
        sums = [F.sum(F.when(F.col(v) == x, m)).alias(f"{c}{k}{x}") for c, m in mass.items() for k, v in enumerate(names) for x in VOTES]
        row = patterns.agg(F.sum("n").alias("n"), *[F.sum(m).alias(c) for c, m in mass.items()], *sums).first()
        if not row["n"]:
            break
        prior = min(0.99, max(0.05, row["good"] / row["n"]))
        given = {c: [tuple((1 - smoothing) * (row[f"{c}{k}{x}"] or 0) / max(row[c], 1e-9) + smoothing * s for x, s in zip(VOTES, START[c], strict=True)) for k in range(len(RULES))] for c in mass}
        for k in range(len(RULES)):
            g, b = list(given["good"][k]), list(given["bad"][k])
            g[0], b[2] = min(g[0], b[0]), min(b[2], g[2])
            given["good"][k], given["bad"][k] = tuple(x / sum(g) for x in g), tuple(x / sum(b) for x in b)
        moved = max(abs(prior - w.prior), *(abs(x - y) for c in mass for new, old in zip(given[c], w.given[c], strict=True) for x, y in zip(new, old, strict=True)))
        w.prior, w.given = prior, given
        if moved < tolerance:
            break
    return w


def base_failed() -> Column:
    return (F.col(f"{P}n_words") < 50) | (100 * F.col(f"{P}n_repeat_words") > 50 * F.col(f"{P}n_words"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, quality) for each row.

    Words are runs of characters other than \\x20 and \\x09-\\x0D. A null text counts as empty: no words, base_failed, not
    kept. Rows that repeat an id are judged one by one; a null id comes back. An empty table gives an empty result.
    Windows are compared by 64-bit hashes within a document.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias(f"{P}text"))
    voted = materialize(votes(measure(narrow, f"{P}text")).drop(f"{P}text"), "quality")
    quality = fit(voted).posterior()
    named = [F.col(P + c).alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return voted.select(id_col, *named, base_failed().alias("base_failed"), (~base_failed() & (quality >= 0.5)).alias("kept"), quality.alias("quality"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, columns as they were, that judge() keeps."""
    voted = materialize(votes(measure(docs, text_col)), "quality")
    return voted.where(~base_failed() & (fit(voted).posterior() >= 0.5)).select(*[F.col(f"`{c}`") for c in docs.columns])
