"""Reply trees against a plain walk, and the template's round trip."""

import hashlib
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegraph.llm import reply_trees
from tidegraph.llm.queries import QUERIES

MESSAGES = "tree_id long, message_id long, parent_id long, score double, role string, text string, leaf string, node string, rank int"


def plain_paths(rows, best):
    """tree -> [(leaf, score, [messages])] of (tree, message, parent, score)."""
    parents, scores = defaultdict(dict), defaultdict(dict)
    for tree, message, parent, score in rows:
        old = parents[tree].get(message, "none")
        parents[tree][message] = parent if old == "none" or old is None else old if parent is None else min(old, parent)
        scores[tree][message] = max(score or 0, scores[tree].get(message, -1e9))
    found = {}
    for tree, up in parents.items():
        paths = []
        for leaf in set(up) - {p for p in up.values() if p in up}:
            path, at = [], leaf
            while at in up and len(path) <= len(up):
                path.append(at)
                at = up[at]
            if len(path) <= len(up):
                paths.append((leaf, sum(scores[tree][m] for m in path), path[::-1]))
        found[tree] = sorted(paths, key=lambda p: (-p[1], p[0]))[:best]
    return found


@pytest.mark.parametrize("best", [1, 3, 100])
def test_paths(spark, best):
    rng = random.Random(best)
    rows = []
    for tree in [*range(12), None]:
        size = rng.choice([1, 2, 9, 40])
        for k in range(size):
            parent = None if k == 0 or rng.random() < 0.05 else rng.randrange(k)
            rows.append((tree, k, parent, rng.choice([None, 0.5, 1.0, -2.0])))
    rows += [(50, k, k - 1, 1.0) for k in range(33)]  # one long path, whose first parent is not there
    rows += [(51, 0, None, 0.0), (51, 1, 2, 5.0), (51, 2, 1, 5.0), (51, 3, 2, 9.0), (51, 4, 0, 0.0)]  # a loop and what hangs on it
    rows += [(52, 0, None, 1.0), (52, 0, None, 3.0), (52, 1, 0, 1.0), (52, 1, 0, 1.0)]  # repeated rows
    frame = spark.createDataFrame([(*r, "user", "x", "a", "b", 7) for r in rows], MESSAGES)
    found = defaultdict(list)
    for r in reply_trees.reply_paths(frame, best).collect():
        found[r.node.tree].append((r["rank"], r.leaf.message, float(r.path_score), r.position, r.node.message))
    expected = plain_paths(rows, best)
    for tree, paths in expected.items():
        plain = [(k, leaf, score, at, m) for k, (leaf, score, path) in enumerate(paths, 1) for at, m in enumerate(path)]
        assert sorted(found[tree]) == sorted(plain)
    assert len(expected[51]) == 1


def test_a_spread_tree_is_ranked_without_meeting_whole(spark):
    """A tree of very many leaves is cut to its first paths in each task."""
    frame = spark.range(0, 5000).select(
        F.lit(1).alias("tree_id"), (F.col("id") + 1).alias("message_id"),
        F.when(F.col("id") > 0, F.lit(1)).alias("parent_id"), (F.col("id") % 77).alias("score"),
    )
    found = reply_trees.reply_paths(frame, 2).where("position = 1").orderBy("rank").collect()
    assert [r.node.message for r in found] == [77, 154]


def test_formatted_paths_and_masks(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [
        (1, 0, None, 0.0, "system", "be <brief> <\\s>"),
        (1, 1, 0, 0.0, "user", said),
        (1, 2, 1, 0.2, "assistant", said + "é日本"),
        (1, 3, 1, 0.9, "assistant", None),
        (1, 4, 2, 0.0, "tool <s> ", "[ROLE] x [/ROLE] "),
        (1, 5, 3, 0.0, None, ""),
        (2, 0, None, None, "assistant", "ends with [ and <"),
        (3, 0, None, None, "user", "nothing learnt"),
        (4, 0, None, None, "assistant", "a"),
        (4, 0, None, None, "assistant", "a"),
    ]
    frame = spark.createDataFrame([(*r, "a", "b", 7) for r in rows], MESSAGES)
    paths = reply_trees.reply_paths(frame, 2)
    made = reply_trees.format_conversations(frame, paths)
    read = made.select(
        "leaf", "rank", "formatted", reply_trees.read_turns(F.col("formatted")).alias("turns"),
        reply_trees.masked_text(F.col("formatted"), F.col("loss_spans")).alias("learnt"), "loss_spans",
    ).collect()
    texts = {(r.leaf.tree, r["rank"]): ([(t.role, t.text) for t in r.turns], r.learnt) for r in read}
    assert texts == {
        (1, 1): ([("system", "be <brief> <\\s>"), ("user", said), ("assistant", ""), ("", "")], ""),
        (1, 2): (
            [("system", "be <brief> <\\s>"), ("user", said), ("assistant", said + "é日本"), ("tool <s> ", "[ROLE] x [/ROLE] ")],
            said + "é日本",
        ),
        (2, 1): ([("assistant", "ends with [ and <")], "ends with [ and <"),
        (3, 1): ([("user", "nothing learnt")], ""),
        (4, 1): ([("assistant", "a"), ("assistant", "a")], "aa"),
    }
    one = next(r for r in read if r.leaf.tree == 1 and r["rank"] == 2)
    start, size = one.loss_spans[0]
    assert one.formatted.encode()[start : start + size].decode() == "<\\/s>[\\INST] ok [\\/INST]é日本"
    assert one.formatted.count("[INST]") == 1


TEXTS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "<", "[", "\\", "/", "s>", "SYS]", " ", "é", "\n", "$1"])).map("".join)


@settings(max_examples=20, deadline=None)
@given(turns=st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "x<s>"]), TEXTS), min_size=1, max_size=8))
def test_round_trip(spark, turns):
    rows = [(0, k, k - 1 if k else None, None, role, text, "", "", 0) for k, (role, text) in enumerate(turns)]
    frame = spark.createDataFrame(rows, MESSAGES)
    paths = frame.select(
        F.expr("struct(0L AS tree, 0L AS message)").alias("leaf"), F.expr("struct(tree_id AS tree, message_id AS message)").alias("node"),
        F.col("message_id").alias("position"), F.lit(1).alias("rank"), F.lit(0).alias("path_score"),
    )
    made = reply_trees.format_conversations(frame, paths)
    row = made.select(
        reply_trees.read_turns(F.col("formatted")).alias("turns"), reply_trees.masked_text(F.col("formatted"), F.col("loss_spans")).alias("learnt")
    ).first()
    assert [(t.role, t.text) for t in row.turns] == turns
    assert row.learnt == "".join(text for role, text in turns if role == "assistant")


def test_op11(spark, tables):
    found = {r.conv_id: r for r in QUERIES["op11_reply_trees"](spark, tables).collect()}
    rows = sorted(map(tuple, spark.read.parquet(f"{tables}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()))
    said = "</s>[INST] ok [/INST]"
    talks = defaultdict(list)
    for conv, _, role, text in [*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)]:
        talks[conv].append((role, text or ""))
    assert set(found) == set(talks)
    for conv, talk in talks.items():
        learnt = "".join(t for role, t in talk if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in talk).encode()).hexdigest()
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars) == (len(talk), digest, len(learnt))
        assert r.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert r.formatted_chars > sum(len(t) for _, t in talk)
