"""Quality rules as weak supervision: rules vote or abstain, and what their votes are worth is learnt from the votes.

Each rule votes good (+1), bad (-1) or abstains (0).  Documents are counted by pattern of votes (at most
3 to the number of rules patterns, whatever the size of the corpus) and expectation-maximisation over those counts estimates how
often each rule that votes is right, on good documents and on each kind of junk, and how common each kind is.
A document's verdict is its posterior probability of being good, not that it passes every rule.

Statistics, votes and posterior are column expressions; the driver sees only the counted patterns.

Defined results: a null text has no words.  Repeated rows count as often as they occur.  An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwright.llm.common import SPACE, written
from spanwright.llm.native import let, words_of

WINDOW = 5
KEEP_FROM = 0.5
ROUNDS = 60
MOST_WRONG = 0.02


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in a window of that many words that the text has twice or more."""
    starts = F.sequence(F.lit(1), F.size(words) - (window - 1))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, window)))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))

        def places(s: Column) -> Column:
            same = lambda e, k: F.get(s, k)["h"].eqNullSafe(e["h"])
            twice = F.filter(s, lambda e, k: same(e, k - 1) | same(e, k + 1))
            return F.sort_array(F.transform(twice, lambda e: e["at"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - x, F.lit(window))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        some = let(let(ordered, places), length)
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(some)

    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(hashes, covered))


def _statistics(text: Column) -> Column:
    count = lambda kept: F.length(F.regexp_replace(text, kept, "")).cast("long")

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            repeated_words(words).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    return F.struct(
        let(words_of(text), of_words).alias("words"),
        let(lines, of_lines).alias("lines"),
        count("[^#*$%&|<>]+").alias("n_symbols"),
        count(r"[^\p{Lu}]+").alias("n_upper"),
        count("[^!]+").alias("n_shouts"),
        count("[^.!?]+").alias("n_stops"),
    )


def statistics(documents: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at, for every row."""
    made = documents.select("doc_id", let(F.coalesce(F.col("text"), F.lit("")), _statistics).alias("s"))
    return made.select("doc_id", "s.words.*", "s.lines.*", "s.n_symbols", "s.n_upper", "s.n_shouts", "s.n_stops")


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def default_rules() -> dict[str, Column]:
    """Rules over the columns of :func:`statistics`; a rule abstains where it has too little to judge by."""
    c = F.col
    return {
        "symbols": _vote(25 * c("n_symbols") > c("word_chars"), 100 * c("n_symbols") <= c("word_chars")),
        "dup_lines": _vote(
            (c("n_lines") >= 4) & (10 * c("n_dup_lines") > 3 * c("n_lines")), (c("n_lines") >= 3) & (c("n_dup_lines") == 0)
        ),
        "repeats": _vote(
            (c("n_words") >= 40) & (5 * c("n_repeat_words") > c("n_words")), (c("n_words") >= 40) & (100 * c("n_repeat_words") <= c("n_words"))
        ),
        "word_length": _vote(
            (c("word_chars") < 3 * c("n_words")) | (c("word_chars") > 11 * c("n_words")),
            (c("word_chars") >= 4 * c("n_words")) & (c("word_chars") <= 9 * c("n_words")),
        ),
        "capitals": _vote(3 * c("n_upper") > c("word_chars"), 10 * c("n_upper") <= c("word_chars")),
        "shouting": _vote(5 * c("n_shouts") > c("n_words"), 50 * c("n_shouts") <= c("n_words")),
        "sentences": _vote(
            (c("n_words") >= 60) & (c("n_stops") == 0), (c("n_words") >= 20) & (40 * c("n_stops") >= c("n_words"))
        ),
    }


@dataclass(frozen=True)
class VoteModel:
    """shares[k] is the share of class k; bad_votes[k][rule] how often the rule, if it votes, votes bad there.

    Class 0 is good; there is one class of junk for each rule, the junk which that rule was written for.
    """

    shares: tuple[float, ...]
    bad_votes: tuple[dict[str, float], ...]

    def accuracy(self, rule: str) -> float:
        """How often a vote that the rule casts is right."""
        return sum(
            share * (votes[rule] if k else 1 - votes[rule]) for k, (share, votes) in enumerate(zip(self.shares, self.bad_votes))
        )

    def odds(self, k: int, rule: str, vote: int) -> float:
        """Log of how much likelier the vote is in class k than on good documents."""
        here, good = self.bad_votes[k][rule], self.bad_votes[0][rule]
        return math.log(here / good) if vote == -1 else math.log((1 - here) / (1 - good)) if vote == 1 else 0.0

    def posterior(self) -> Column:
        """Probability of good as an expression over the vote columns ``vote_<rule>``."""
        against = F.lit(0.0)
        for k in range(1, len(self.shares)):
            logit = F.lit(math.log(self.shares[k] / self.shares[0]))
            for rule in self.bad_votes[0]:
                vote = F.col(f"vote_{rule}")
                logit += F.when(vote == -1, self.odds(k, rule, -1)).when(vote == 1, self.odds(k, rule, 1)).otherwise(0.0)
            against += F.exp(logit)
        return F.lit(1.0) / (F.lit(1.0) + against)


def estimate(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over counted vote patterns.

    Junk comes in kinds, and most kinds break one rule while they pass the others, so bad documents are a mixture with
    one class for each rule; a single class of junk would take every kind but the commonest for good.  Priors,
    in pseudo-documents, settle which class is which: a bad vote is rare on good documents (1 in 100), common
    in the rule's own class of junk and possible in the others, and each class of junk holds 1 document in 100.
    At most ``MOST_WRONG`` of good documents get a rule's bad vote.
    """
    total = sum(n for _, n in patterns)
    weight = max(10.0, 0.01 * total)
    classes = range(len(names) + 1)
    beliefs = []
    for votes, _ in patterns:
        broken = [r for r, v in enumerate(votes) if v == -1]
        first = [0.97] + [0.03 / len(names)] * len(names)
        if broken:
            first = [0.1] + [0.9 / len(broken) if r in broken else 0.0 for r in range(len(names))]
        beliefs.append(first)
    shares, bad_votes = [], []
    for _ in range(rounds):
        shares = [sum(b[k] * n for b, (_, n) in zip(beliefs, patterns)) + 0.01 * weight * (k > 0) for k in classes]
        shares = [max(x / sum(shares), 1e-9) for x in shares]
        bad_votes = []
        for k in classes:
            own: dict[str, float] = {}
            for r, name in enumerate(names):
                cast = sum(b[k] * n for b, (v, n) in zip(beliefs, patterns) if v[r])
                against = sum(b[k] * n for b, (v, n) in zip(beliefs, patterns) if v[r] == -1)
                if not k:
                    own[name] = min((against + 0.01 * weight) / (cast + weight), MOST_WRONG)
                else:
                    prior, trust = (0.9, weight) if k == r + 1 else (0.1, 0.1 * weight)
                    own[name] = min(max((against + prior * trust) / (cast + trust), 0.01), 0.99)
            bad_votes.append(own)
        model = VoteModel(tuple(shares), tuple(bad_votes))
        beliefs = []
        for votes, _ in patterns:
            logits = [
                math.log(shares[k] / shares[0]) + sum(model.odds(k, n, v) for n, v in zip(names, votes)) for k in classes
            ]
            top = max(logits)
            likely = [math.exp(x - top) for x in logits]
            beliefs.append([x / sum(likely) for x in likely])
    return VoteModel(tuple(shares), tuple(bad_votes))


def judge(documents: DataFrame, rules: dict[str, Column] | None = None, keep_from: float = KEEP_FROM) -> DataFrame:
    """Statistics, votes, posterior, base_failed and kept for every row."""
    rules = rules or default_rules()
    names = list(rules)
    voted = written(statistics(documents).withColumns({f"vote_{n}": v for n, v in rules.items()}), "votes")
    counted = voted.groupBy(*[f"vote_{n}" for n in names]).count().collect()
    model = estimate(sorted((tuple(r[:-1]), r[-1]) for r in counted), names)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        voted.withColumn("posterior", model.posterior())
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_from))
    )
