"""Repair of conversations: every way of editing tried out, pieces against wholes, and the edges."""
import hashlib
import re
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tidemark.llm import repair

GOOD, BEGUN = re.compile("(s?(ua)+)?"), re.compile("s?(ua)*u?")


@lru_cache(None)
def plain_edits(turns):
    """Least (cost, edits, lines) of all edit sequences, by trying each; turns: (role, text, fault)."""
    best = None

    def go(k, roles, cost, edits, lines, inserts):
        nonlocal best
        if best and cost > best[0] or not BEGUN.fullmatch(roles):
            return
        if k == len(turns) and GOOD.fullmatch(roles):
            best = min(best or (cost, edits, lines), (cost, edits, lines))
        if inserts < 3:
            for role in ("user", "assistant"):
                go(k, roles + role[0], cost + 3, edits + "I", (*lines, role + ":"), inserts + 1)
        if k < len(turns):
            role, text, fault = turns[k]
            go(k + 1, roles, cost + 4, edits + "D", lines, 0)
            if fault != repair.GONE:
                more = 3 * (fault == repair.CUT)
                go(k + 1, roles + (role[:1] or "?"), cost + more, edits + "K", (*lines, f"{role}:{text}"), 0)
                for new in ("user", "assistant"):
                    go(k + 1, roles + new[0], cost + 3 + more, edits + "R", (*lines, f"{new}:{text}"), 0)

    go(0, "", 0, "", (), 0)
    return best


def searched(turns, cuts=()):
    """The same through Search, in pieces that end at `cuts`."""
    bounds = [0, *cuts, len(turns)]
    pieces = [turns[a:b] for a, b in zip(bounds, bounds[1:])]

    def run(piece, state):
        search = repair.Search(state)
        for role, _, fault in piece:
            search.step(role[:1], fault)
        return search

    ways = repair.ways_through([[run(p, s).ranked() for s in range(4)] for p in pieces])
    cost, edits = 0, b""
    for piece, (first, last) in zip(pieces, ways):
        search = run(piece, first)
        cost += search.close(last)
        edits += bytes(search.final)
    return cost, edits.decode()


turns_of = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.just("t"), st.integers(0, 2)), max_size=4)


@settings(max_examples=80, deadline=None)
@given(turns_of, st.data())
def test_search_equals_all_ways(turns, data):
    cuts = sorted(data.draw(st.lists(st.integers(0, len(turns)), max_size=3)))
    want = plain_edits(tuple(turns))
    assert searched(turns) == want[:2]
    assert searched(turns, cuts) == want[:2]


def test_tree_stays_small():
    """Survivors share their ancestors soon: what is not final stays short, and the tree has few nodes."""
    rng = np.random.default_rng(1)
    search, most = repair.Search(), 0
    for _ in range(20_000):
        search.step("usa"[rng.integers(3)], int(rng.integers(3)))
        search.final.clear()

        def size(node):
            return (1, len(node.edits)) if not node.kids else tuple(map(sum, zip((1, len(node.edits)), *(size(k) for k in node.kids))))

        nodes, edits = size(search.root)
        assert nodes <= 7
        most = max(most, edits)
    assert most < 500


def rows_of(frame):
    return {r["conv_id"]: r.asDict() for r in frame.collect()}


def test_faults_and_repair(spark):
    rows = [(1, 0, "user", "Hi?"), (1, 1, "user", "Hi?"), (1, 2, "assistant", "no end"), (1, 5, "assistant", " \t"), (1, None, "system", "Be brief."),
            (2, 0, "user", None), (None, 3, None, "x."), (None, 3, None, "x."), (3, 7, "user", "A."), (3, 8, "assistant", "B! \n")]
    found = rows_of(repair.repair(spark.createDataFrame([(*r, None) for r in rows], "conv_id bigint, turn bigint, role string, text string, cost string"),
                                  spark.createDataFrame([(k,) for k in (1, 2, 3, 9, None)], "conv_id bigint")))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert found[1] == {"conv_id": 1, "gaps": 2, "blank": 1, "duplicate": 1, "truncated": 1, "illegal": 2, "cost": 11, "audit": "KKDKD",
                        "repaired_sha256": sha("system:Be brief.\nuser:Hi?\nassistant:no end")}
    assert found[2]["blank"] == 1 and found[2]["audit"] == "D" and found[2]["repaired_sha256"] == sha("")
    assert (found[None]["duplicate"], found[None]["illegal"], found[None]["gaps"]) == (1, 1, 0)
    assert found[3]["audit"] == "KK" and found[3]["cost"] == 0 and found[3]["repaired_sha256"] == sha("user:A.\nassistant:B! \n")
    assert found[9] == {"conv_id": 9, **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "", "repaired_sha256": sha("")}


def test_empty_table(spark):
    assert repair.repair(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_hot_conversation_in_many_pieces(spark, monkeypatch, kind):
    """A conversation of 3,000 turns over several ranges, its text in parts, equals the search in one go."""
    monkeypatch.setattr(repair, "PART_BYTES", 300)
    rng = np.random.default_rng(2)
    rows = [(7, k, ["user", "assistant", "system", "assistant", "user"][rng.integers(5)], ["a.", "b", "", f"text {k}!", f"long {k} " * 20 + "."][rng.integers(5)]) for k in range(3000)]
    rows += [(8, 1, "user", "copy.")] * 500 + [(9, k, "user" if k % 2 == 0 else "assistant", f"{k}.") for k in range(6)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(f"cast(conv_id as {kind}) conv_id", "turn", "role", "text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")      # else the little table is one range
    plans, plan = [], repair._plan
    monkeypatch.setattr(repair, "_plan", lambda pieces: plans.append(plan(pieces)) or plans[-1])
    found = {int(k): v for k, v in rows_of(repair.repair(frame.repartition(5))).items()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len([k for k in plans[0] if str(k[1]) == "7"]) > 1
    seen, turns, kinds, before, illegal = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0), "", 0
    for _, _, role, text in rows[:3000]:
        kind = "blank" if not text.strip() else "duplicate" if (role, text) in seen else "truncated" if text.strip()[-1] not in ".!?" else ""
        seen.add((role, text))
        if kind:
            kinds[kind] += 1
        illegal += bool(before) and before + role[0] not in ("su", "ua", "au")
        before = role[0]
        turns.append((role, text, {"": repair.SOUND, "truncated": repair.CUT}.get(kind, repair.GONE)))
    cost, audit = searched(turns)
    state, lines, waiting = repair.NOTHING, [], iter(turns)
    for edit in audit:
        role, text, _ = next(waiting) if edit != "I" else ("", "", 0)
        if edit != "D":
            state = repair.KEPT[role[0]][state] if edit == "K" else repair.NEXT[state]
            lines.append(f"{role if edit == 'K' else repair.ROLE[state]}:{text}")
    assert (found[7]["cost"], found[7]["illegal"], {k: found[7][k] for k in kinds}) == (cost, illegal, kinds)
    assert found[7]["audit"] == audit
    assert found[7]["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert found[8]["duplicate"] == 499 and found[8]["audit"].count("D") == 499 and found[9]["audit"] == "KKKKKK"
