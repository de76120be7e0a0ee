import random

from pyspark.sql import functions as F

from spanwright.llm import preference_pairs as pp

SCHEMA = "conv_id long, turn long, role string, text string, side string, place int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 0) for r in rows], SCHEMA)


def brute(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t, r, x))
    groups = {}
    for c in sorted(convs):
        convs[c].sort()
        groups.setdefault((convs[c][0][1:], c // 1024), []).append(c)
    left, pairs = {}, []
    for (first, _), ids in groups.items():
        pairs += list(zip(ids[::2], ids[1::2]))
        if len(ids) % 2:
            left.setdefault(first, []).append(ids[-1])
    for ids in left.values():
        ids.sort()
        pairs += list(zip(ids[::2], ids[1::2]))
    out = []
    for a, b in pairs:
        x, y = convs[a], convs[b]
        n = 0
        while n < min(len(x), len(y)) and x[n] == y[n]:
            n += 1
        for seg, turns in (("prompt", x[:n]), ("chosen", x[n:]), ("rejected", y[n:])):
            for t, role, text in turns:
                on = seg != "prompt" and role == "assistant"
                out.append((a, b, seg, t, role, f"<|{role}|>\n{text}<|end|>\n", on, len(role) + 5))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for c in range(0, 9000, 13):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, "assistant" if t % 2 else "user", rng.choice(["hi", "ho", "é", ""]) if t else rng.choice(["q1", "q2", "q3", f"q{c}"])))
    conversations = frame(spark, rows)
    got = pp.format_pairs(conversations, pp.pair_by_opening(conversations)).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_every_conversation_is_in_one_pair(spark):
    rows = [(4, 0, "user", "q"), (5, 0, "user", "q"), (5, 1, "assistant", "a"), (7, 0, "user", "lone"), (None, 0, "user", "q"), (-2, 3, "user", "x")]
    conversations = frame(spark, rows)
    got = pp.format_pairs(conversations, pp.pair_by_id(conversations)).collect()
    assert sorted((r.chosen_id, r.rejected_id, r.segment, r.turn, r.trained) for r in got) == [
        (-2, -1, "chosen", 3, False), (4, 5, "prompt", 0, False), (4, 5, "rejected", 1, True), (6, 7, "rejected", 0, False)]


def test_all_sides(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "r"), (0, 3, "assistant", "b"), (0, 4, "user", "bye"),
            (1, 0, "user", "s"), (1, 1, "assistant", None), (2, 0, "user", "no reply"), (3, 0, "user", "x"), (3, 1, "assistant", "lone"),
            (8, 0, "user", "same"), (8, 1, "assistant", "1"), (11, 0, "user", "same"), (11, 1, "assistant", "2"), (None, 0, "user", "q")]
    got = pp.format_sides(pp.all_sides(frame(spark, rows))).collect()
    mark = lambda x: "" if x is None else x
    want = [
        (0, 1, "prompt", 0, "q", False), (0, 1, "prompt", 1, "a", False), (0, 1, "prompt", 2, "r", False), (0, 1, "chosen", 3, "b", True),
        (0, 1, "chosen", 4, "bye", False), (0, 1, "rejected", 3, "", True), (1, 0, "prompt", 0, "s", False), (1, 0, "chosen", 1, "", True),
        (1, 0, "rejected", 1, "b", True), (2, None, "single", 0, "no reply", False), (3, None, "single", 0, "x", False), (3, None, "single", 1, "lone", True),
        (8, 11, "prompt", 0, "same", False), (8, 11, "chosen", 1, "1", True), (8, 11, "rejected", 1, "2", True)]
    seen = [(r.chosen_id, r.rejected_id, r.segment, r.turn, mark(r.rendered.split("|>\n", 1)[1].removesuffix("<|end|>\n")), r.trained) for r in got]
    assert sorted(seen, key=str) == sorted(want, key=str)
    assert pp.format_sides(pp.all_sides(frame(spark, []))).count() == 0


def test_the_query_has_prompts_and_equals_its_sql(spark):
    import duckdb

    from spanwright.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in queries.op6_preference_pairs(spark, sf).collect()]
    assert sum(r[2] == "prompt" for r in rows) > 20
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert sorted(rows, key=str) == sorted(con.execute(pp.ORACLE_SQL).fetchall(), key=str)
    conversations = spark.read.parquet(f"{sf}/conversations.parquet")
    sides = {r[0] for r in rows} | {r[1] for r in rows if r[1] is not None}
    assert {r[0] for r in conversations.select("conv_id").distinct().collect()} == sides


def test_odd_rows(spark):
    rows = [(1, 0, "user", "q"), (2, 0, "user", "q"), (1, 1, "assistant", None), (2, 1, "assistant", ""), (None, 0, "user", "q"),
            (3, None, None, "z"), (3, None, None, "z"), (4, None, None, "z"), (4, None, None, "z"), (4, 2, "assistant", "w" * 100000)]
    conversations = frame(spark, rows)
    got = pp.format_pairs(conversations, pp.pair_by_opening(conversations)).collect()
    by = {}
    for r in got:
        by.setdefault((r.chosen_id, r.segment), []).append(r)
    assert {k: len(v) for k, v in by.items()} == {(1, "prompt"): 1, (1, "chosen"): 1, (1, "rejected"): 1, (3, "prompt"): 2, (3, "rejected"): 1}
    whole = {r.chosen_id: r for r in pp.assemble(spark.createDataFrame(got, pp.format_pairs(conversations, pp.pair_by_opening(conversations)).schema)).collect()}
    assert whole[1].prompt == "<|user|>\nq<|end|>\n" and whole[3].chosen == ""
    empty = frame(spark, [])
    assert pp.format_pairs(empty, pp.pair_by_opening(empty)).count() == 0


def test_no_python_in_the_plan(spark):
    conversations = frame(spark, [(1, 0, "user", "q"), (2, 0, "user", "q")])
    plan = pp.format_pairs(conversations, pp.pair_by_opening(conversations))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
    assert F is not None
