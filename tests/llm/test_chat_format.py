"""Chat formatting against all repairs, and the cut path against the whole one."""

from __future__ import annotations

import itertools
import random

import pytest

from rotaframe.llm.chat_format import FOREVER, START, Costs, chain, chat_format, repair, role_number, steps, transition

COSTS = Costs()


def cheapest(roles: list[int]) -> int:
    """Every sequence of steps."""
    best = {START: 0}
    for role in roles:
        after: dict[int, int] = {}
        for state, cost in best.items():
            for step in steps(state, role, COSTS):
                after[step.to] = min(after.get(step.to, FOREVER), cost + step.cost)
        best = after
    return min(best.values())


def test_every_short_conversation_is_repaired_at_least_cost():
    for n in range(1, 5):
        for roles in itertools.product(range(4), repeat=n):
            cost, taken = repair(list(roles), COSTS)
            assert cost == cheapest(list(roles)) == sum(s.cost for _, s in taken)
            state, messages = START, []
            for before, step in taken:
                assert before == state
                if not step.merged:
                    messages += [*step.inserted, step.to]
                state = step.to
            if messages and messages[0] == 1:
                messages = messages[1:]
            assert messages == [2 + i % 2 for i in range(len(messages))]


def test_legal_conversations_are_kept():
    for roles in ([1, 2, 3, 2, 3], [2, 3], [2], [1, 2]):
        assert repair(roles, COSTS)[0] == 0


def test_products_may_be_bracketed_anyhow():
    rng = random.Random(1)
    m = [transition(rng.randrange(4), COSTS) for _ in range(6)]
    left = m[0]
    for x in m[1:]:
        left = chain(left, x)
    right = m[-1]
    for x in m[-2::-1]:
        right = chain(x, right)
    assert (left == right).all()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 60)):
            out.append((conv, turn, rng.choice(["user", "assistant", "system", "User ", "tool", None]), rng.choice(["a", "b <|end|>", "", None])))
    return [*out, (None, None, None, None), (5, None, "user", "x"), (5, 3, "user", "twice"), (5, 3, "user", "twice")]


def test_cut_conversations_cost_what_whole_ones_do(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = chat_format(df).collect()
    cut = chat_format(df, large=7).collect()
    assert len(whole) == len(cut) == len(rows)
    of = lambda out: {r.conv_id: r.conversation_cost for r in out}
    assert of(whole) == of(cut)
    for out in (whole, cut):
        for conv in {r.conv_id for r in out}:
            turns = [r[:4] for r in rows if r[0] == conv]
            assert {r.conversation_cost for r in out if r.conv_id == conv} == {cheapest([role_number(t[2]) for t in sorted(turns, key=lambda t: [(x is not None, x if x is not None else 0) for x in t[1:2]] + [(x is not None, x or "") for x in t[2:]])])}


def test_cut_conversations_are_repaired_as_whole_ones(spark, rows):
    rows = [*rows, *((100, i, r, "t") for i, r in enumerate((None, None, None, "user")))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = sorted(map(tuple, chat_format(df).collect()), key=repr)
    for large in (1, 2, 7):
        assert sorted(map(tuple, chat_format(df, large=large).collect()), key=repr) == whole


def test_rendering(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "hi"), (1, 1, "user", "a"), (1, 2, "user", "<|end|>")], "conv_id long, turn long, role string, text string")
    out = "".join(r.rendered for r in sorted(chat_format(df).collect(), key=lambda r: r.turn))
    assert out in ("<|user|>\nhi\n\na\n\n< |end|><|end|>\n", "<|user|>\n<|end|>\n<|assistant|>\nhi<|end|>\n<|user|>\na\n\n< |end|><|end|>\n")


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, rendered string")
    assert chat_format(df).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "a", "clash")], "conv_id long, turn long, role string, text string, rendered string")
    assert chat_format(df).collect()[0].rendered == "<|user|>\na<|end|>\n"
