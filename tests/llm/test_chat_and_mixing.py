import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chat, queries, sql
from loomgraph.llm.mixing import leaf_budgets, mix_sources

TURNS = [
    (1, 0, "user", "a"), (1, 1, "assistant", "b<t>&lt;"), (1, 2, "assistant", "</s>[INST]"), (1, 3, "user", "&amp;#91; é😀"), (2, 0, "assistant", None), (3, None, None, "x"),
    (3, 0, "sys]tem<", "y"), (4, 1, "user", ""), (4, 1, "user", ""), (4, 0, "assistant", "first"), (None, 0, "user", "no id"), (5, 0, "assistant", "long " * 30_000),
]


def test_formats_and_reads_back(spark):
    frame = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, turns string")
    done = chat.format_conversations(frame)
    rows = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    want = defaultdict(list)
    for conv, turn, role, text in TURNS:
        want[conv].append((turn is not None, turn, role or "", text or ""))
    assert len(rows) == len(want)
    for r in rows:
        turns = [(role, text) for _, _, role, text in sorted(want[r.conv_id], key=lambda t: (t[0], t[1] or 0, t[2], t[3]))]
        assert [tuple(t) for t in r.turns] == turns
        assert r.loss == "".join(text for role, text in turns if role == "assistant")
    first = next(r for r in rows if r.conv_id == 1)
    assert first.formatted.count(chat.OPEN) == 3  # two adjacent turns share a block
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_long_conversations(spark):
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], f"é{i}") for i in range(20_000)] + [(k, i, "assistant", "x") for k in (127, 128, 129, 256, 257) for i in range(k)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(frame)
    got = {r.conv_id: r for r in done.select("conv_id", chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.size("loss_spans").alias("n")).collect()}
    assert got[1].loss == "".join(t for _, _, role, t in rows[:20_000] if role == "assistant")
    assert all(got[k].loss == "x" * k and got[k].n == k for k in (127, 128, 129, 256, 257))


def test_conversation_query_has_the_control_case(spark, tmp_path):
    frame = spark.createDataFrame([t for t in TURNS if t[0]], "conv_id long, turn long, role string, text string")
    frame.coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in queries.op4_chat_format(spark, str(tmp_path)).collect()}
    text = queries.CONTROL_TEXT
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest() and got[-1].loss_chars == len(text)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert {tuple(r) for r in con.sql(sql.OP4).fetchall()} == {tuple(r) for r in got.values()}


def budgets(spark, rows, budget, epochs):
    leaves = spark.createDataFrame(rows, "domain string, lang string, tokens long, rows long")
    return {(r.domain, r.lang): r.budget for r in leaf_budgets(leaves, ["domain", "lang"], ["CASE domain WHEN 'a' THEN 3 ELSE 1 END", "1"], budget, epochs).collect()}


def test_shortages_go_to_siblings_before_ancestors(spark):
    rows = [("a", "x", 100, 1), ("a", "y", 1000, 1), ("b", "x", 1000, 1), ("b", "y", 1000, 1)]
    # 1550 tokens: a gets three quarters, 1162, but has 1100; within a, x is short and y takes it
    assert budgets(spark, rows, (1, 2), 1) == {("a", "x"): 100, ("a", "y"): 1000, ("b", "x"): 225, ("b", "y"): 225}
    # 775: a gets 581; x can use 100 of its 290, y gets the rest
    assert budgets(spark, rows, (1, 4), 1) == {("a", "x"): 100, ("a", "y"): 481, ("b", "x"): 96, ("b", "y"): 96}
    assert sum(budgets(spark, rows, (9, 1), 2).values()) == 6200  # never more than the epochs allow


@pytest.mark.parametrize("epochs", [1, 3])
def test_prefixes_keep_budgets_and_epochs(spark, epochs):
    g = random.Random(1)
    rows = [(i, g.choice(["a", "a", "a", "b", None]), "w " * g.randint(0, 30), "z") for i in range(1500)] + [(None, "a", "w w", "z"), (3, "a", None, "z"), (3, "a", None, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string, epoch string")
    got = mix_sources(frame, {"lang": F.col("lang")}, ["CASE lang WHEN 'a' THEN 1 ELSE 4 END"], (1, 2), epochs, seed=2).collect()
    tokens, all_tokens = defaultdict(int), sum(len((t or "").split()) for _, _, t, _ in rows)
    for r in got:
        tokens[r.lang] += r.n_tokens
        assert 0 <= r.epoch < epochs
    assert all_tokens * 0.4 < sum(tokens.values()) <= all_tokens // 2
    full = defaultdict(set)
    for r in got:
        full[(r.lang, r.epoch)].add(r.doc_id)
    for (lang, epoch), ids in full.items():
        if epoch:
            assert ids <= full[(lang, epoch - 1)]  # an epoch begins when the one before is whole
    assert mix_sources(frame.limit(0), {"lang": F.col("lang")}, ["1"]).count() == 0
