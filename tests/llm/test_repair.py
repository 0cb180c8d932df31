import itertools
import random
import re
from hashlib import sha256

import pytest

from filamenta.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, cost long, piece string"
WORD = re.compile("[^\x20\x09-\x0d]")


def cheapest(turns):
    """(cost, audit, repaired) by a search over every string of edits, cheapest and then ASCII-least first."""
    best = {(0, 0): [(0, "", ())]}
    done = []
    todo = [(0, "", 0, 0, ())]
    known = {}
    while todo:
        todo.sort()
        cost, audit, i, q, said = todo.pop(0)
        if (i, q) in known and known[i, q] <= (cost, audit):
            continue
        known[i, q] = (cost, audit)
        if i == len(turns) and q in (0, 3):
            done.append((cost, audit, said))
            if cost > done[0][0]:
                break
        free = "assistant" if q == 2 else "user"
        to = 3 if q == 2 else 2
        todo.append((cost + 2, audit + "I", i, to, (*said, free + ":")))
        if i < len(turns):
            role, text, must, cut = turns[i]
            todo.append((cost + 3, audit + "D", i + 1, q, said))
            if not must:
                todo.append((cost + 2 + cut, audit + "R", i + 1, to, (*said, f"{free}:{text}")))
                moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
                if (q, role[:1]) in moves:
                    todo.append((cost + cut, audit + "K", i + 1, moves[q, role[:1]], (*said, f"{role}:{text}")))
    assert best
    return min(done)


def plain(rows):
    out = {}
    for conv, group in itertools.groupby(sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, " " if r[2] is None else r[2], " " if r[3] is None else r[3])), key=lambda r: r[0]):
        turns, seen, counts, numbers = [], set(), [0, 0, 0], []
        for _, turn, role, text in group:
            role, text = (" " if x is None else x for x in (role, text))
            blank, words = not WORD.search(text), WORD.findall(text)
            repeat = (role, text) in seen
            cut = not blank and not repeat and words[-1] not in ".!?"
            seen.add((role, text))
            counts = [a + b for a, b in zip(counts, (blank, repeat and not blank, cut))]
            turns.append((role, text, blank or repeat, int(cut)))
            numbers += [turn] if turn is not None else []
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, said = cheapest(turns)
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        out[conv] = (gaps, *counts, illegal, cost, audit, sha256("\n".join(said).encode()).hexdigest())
    return out


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            rows.append((c if c else None, rng.choice([t, t, t + 1, None]), role, rng.choice(["Yes.", "No!", "cut", "why? ", " \t", "", None, "x", "é."])))
    return rows


def found(spark, rows, **kw):
    out = repair.audited(spark.createDataFrame([(*r, 1, "p") for r in rows], SCHEMA), **kw)
    return {r[0]: tuple(r[1:]) for r in out.collect()}


@pytest.mark.parametrize("kw", [{}, {"piece": 3}, {"chars": 12}])
def test_equals_every_edit_tried(spark, kw):
    rows = conversations(1, 60, 9)
    assert found(spark, rows, **kw) == plain(rows)


def test_pieces_of_one_long_conversation(spark):
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice([f"t{t}.", f"u{t}", "again."])) for t in range(3000)] + [(8, 0, "user", "a."), (8, 1, "assistant", "b.")]
    assert found(spark, rows, piece=200) == found(spark, rows, piece=4000)


def test_repeats_of_one_row_and_all_that_must_go(spark):
    rows = [(1, 5, "user", "same.")] * 30 + [(2, None, None, None), (3, 1, "assistant", "a.")]
    assert found(spark, rows) == found(spark, rows, piece=4) == plain(rows)


def test_layers_hold_exact_costs():
    turns = [("u", False, 0), ("u", False, 1), ("x", True, 0), ("a", False, 0)]
    n = len(turns)
    for cost, layer in zip(range(12), repair.layers(turns, repair.CLOSING), strict=False):
        assert len(layer) == n + 1 and all(0 <= held < 16 for held in layer)
        if layer[0] & 1:
            assert cost == repair.solved(turns)[0]
            break


def test_repaired_turns_alternate(spark):
    rows = spark.createDataFrame([(*r, 1, "p") for r in conversations(4, 40, 8)], SCHEMA)
    kept = {}
    for r in repair.repaired_turns(rows).orderBy("conv_id", "position").collect():
        kept.setdefault(r["conv_id"], []).append(r["role"][:1])
    assert kept and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in kept.values())
    with pytest.raises(ValueError):
        repair.repaired_turns(rows, piece=2)


def test_empty_table_and_a_very_long_text(spark):
    assert found(spark, []) == {}
    rows = [(1, 0, "user", "word " * 400_000), (1, 1, "assistant", "Done.")]
    assert found(spark, rows) == found(spark, rows, piece=1) == plain(rows)


def test_damage(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", "A b. C?") for c in range(40) for t in range(4)] + [(None, None, None, None)]
    from zlib import crc32

    want = []
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        way = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if way == 4 else role, "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text)
        want += [] if way == 0 else [row] * (2 if way == 3 else 1)
    got = [tuple(r) for r in queries.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
