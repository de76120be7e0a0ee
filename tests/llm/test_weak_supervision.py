import random
import re

from spanwright.llm import weak_supervision as ws

SPACE = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def texts():
    rng = random.Random(1)
    vocabulary = ["a", "b", "cc", "Dé", "#x", "e.", "f!", "\U0001f600", "|"]
    made = ["".join(rng.choice(vocabulary[: rng.randint(1, 9)]) + rng.choice([" ", " ", "\n", "\t", "\n\n", " "]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return [None, "", " ", "\n \n", "a b c d e a b c d e", "one two three four", *made, "same words here again now. " * 3000]


def test_counts_against_brute_force(spark):
    data = texts()
    docs = spark.createDataFrame([(i, t, 7, 0.5) for i, t in enumerate(data)], "doc_id long, text string, n_words int, posterior double")
    got = {r.doc_id: r for r in ws.judge(docs).collect()}
    for i, t in enumerate(data):
        r, want = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept) and 0 <= r.posterior <= 1


def brute_posterior(votes, model, names):
    likely = []
    for share, bad in zip(model.shares, model.bad_votes):
        for v, n in zip(votes, names):
            share *= bad[n] if v == -1 else 1 - bad[n] if v == 1 else 1
        likely.append(share)
    return likely[0] / sum(likely)


def test_estimates_recover_known_kinds_of_junk(spark):
    rng = random.Random(2)
    names = ["p", "q", "r", "s"]
    counts, right, n = {}, 0, 40000
    truth = {}
    for _ in range(n):
        kind = rng.choices([0, 1, 2, 3, 4], [0.8, 0.08, 0.05, 0.04, 0.03])[0]
        votes = tuple(
            0 if rng.random() < 0.1 else (-1 if rng.random() < (0.9 if kind == r + 1 else 0.005) else 1) for r in range(4)
        )
        counts[votes] = counts.get(votes, 0) + 1
        truth.setdefault(votes, []).append(kind == 0)
    model = ws.estimate(sorted(counts.items()), names)
    assert abs(model.shares[0] - 0.8) < 0.04
    for r, name in enumerate(names):
        assert model.bad_votes[0][name] < 0.021 and model.bad_votes[r + 1][name] > 0.8 and model.accuracy(name) > 0.8
    rows = spark.createDataFrame([tuple(v) for v in counts], [f"vote_{x}" for x in names])
    for row in rows.withColumn("p", model.posterior()).collect():
        assert abs(row[-1] - brute_posterior(row[:-1], model, names)) < 1e-9
        right += sum(t == (row[-1] >= 0.5) for t in truth[tuple(row[:-1])])
    # no verdict does better than the one that always takes the commoner truth of a pattern
    assert right > sum(max(sum(t), len(t) - sum(t)) for t in truth.values()) - 0.005 * n


def test_empty_table(spark):
    assert ws.judge(spark.createDataFrame([], "doc_id long, text string")).count() == 0
