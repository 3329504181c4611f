import hashlib
from collections import defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from shapewright.llm import chat

ODD = st.text(alphabet="<|\\>nim_startend\n é", max_size=30)


@given(ODD, ODD)
def test_escapes_are_reversible_and_hide_markers(role, text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(role)) == role and "\n" not in chat.escape_role(role)
    whole = f"{chat.START}{chat.escape_role(role)}\n{chat.escape(text)}{chat.END}\n"
    assert chat.read_back(whole * 2, [])[0] == [(role, text)] * 2


def brute_paths(rows):
    trees = defaultdict(dict)
    for t, m, p in rows:
        trees[t][m] = p
    out = set()
    for t, parents in trees.items():
        for leaf in set(parents) - set(parents.values()):
            m, up = leaf, 0
            while m in parents:
                out.add((t, leaf, m, up))
                m, up = parents[m], up + 1
    return out


def test_paths_of_branching_trees(spark):
    rows = [("a", 1, None), ("a", 2, 1), ("a", 3, 1), ("a", 4, 3), ("a", 5, 3), ("a", 6, 5), ("b", 1, None), ("c", 9, 77), ("c", 10, 9)]
    rows += [("d", i, i - 1 if i else None) for i in range(37)]
    messages = spark.createDataFrame(rows, "tree string, msg long, parent long")
    assert {tuple(r) for r in chat.paths(messages).collect()} == brute_paths(rows)


def test_branches_are_ranked_by_score(spark):
    rows = [("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "low", 1.0), ("a", 3, 1, "assistant", "high", 5.0), ("a", 4, 3, "user", "more", None), ("a", 5, 2, "user", "less", None)]
    messages = spark.createDataFrame(rows, "tree string, msg long, parent long, role string, text string, score double")
    walked = chat.paths(messages)
    best = chat.format_paths(chat.choose(walked, messages, 1), messages).collect()
    assert [chat.read_back(r.formatted, [tuple(s) for s in r.loss]) for r in best] == [([("user", "q"), ("assistant", "high"), ("user", "more")], ["high"])]
    both = chat.format_paths(chat.choose(walked, messages, None), messages).collect()
    assert {(r.leaf, r.rank) for r in both} == {(4, 1), (5, 2)}


def test_circles_have_no_path(spark):
    rows = [("b", 1, None), ("b", 2, 1), *[("d", i, i - 1 if i else None) for i in range(90)]]
    circles = [("a", 1, 2), ("a", 2, 1), ("b", 5, 6), ("b", 6, 7), ("b", 7, 5), ("b", 8, 7), ("b", 9, 8), ("d", 200, 200), ("d", 201, 200)]
    messages = spark.createDataFrame(rows + circles, "tree string, msg long, parent long")
    assert {tuple(r) for r in chat.paths(messages).collect()} == brute_paths(rows)


def expected(rows):
    by = defaultdict(list)
    for conv, turn, role, text in [*rows, (-1, 0, "user", chat.PROBE), (-1, 1, "assistant", chat.PROBE)]:
        by[conv].append((turn is not None, turn or 0, role is not None, role or "", text is not None, text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t[5] for t in turns if t[3] == "assistant")
        out[conv] = (len(turns), hashlib.sha256("".join(f"{t[3]}\n{t[5]}\n" for t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def run(spark, at):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.op8(spark, str(at)).collect()}


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert run(spark, sf) == expected(rows)


def test_edges(spark, tmp_path):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>\\<\\|"), (1, 1, "assistant", "tie"), (1, 1, "assistant", "tie"), (None, 0, None, "x"), (2, None, "assistant", ""), (3, 0, "a\nb<|", "é" * 1000), (4, 0, "assistant", "long <| text " * 20_000)]
    rows += [(5, i, ["user", "assistant"][i % 2], f"t{i}") for i in range(150)]
    df = spark.createDataFrame([(*r, "own") for r in rows], "conv_id long, turn long, role string, text string, leaf string")
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    assert run(spark, tmp_path) == expected(rows)
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert run(spark, tmp_path) == expected([])
