"""Repairs against all edit strings of small conversations, and segments against whole conversations."""

import hashlib
import heapq
import itertools
import random
import re

from riskspark.llm import conversation_repair as cr
from riskspark.llm.queries import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, sid int, place int, conv string, open int"
GRAMMAR = re.compile(r"(s?(ua)+)?$")


def brute(rows):
    """(cost, audit, repaired lines) by a search over all edits in the order of (cost, audit)."""
    seen, found = set(), []
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        found.append("b" if not body else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    heap = [(0, "", 0, (), "")]
    while heap:
        cost, audit, at, lines, initials = heapq.heappop(heap)
        if at == len(rows) and GRAMMAR.match(initials):
            return cost, audit, lines, found
        if len(audit) > 2 * len(rows) + 3 or not re.match(r"s?(ua)*u?$", initials):
            continue
        if not audit.endswith("II"):
            for role in ("user", "assistant"):
                heapq.heappush(heap, (cost + 2, audit + "I", at, (*lines, role + ":"), initials + role[0]))
        if at < len(rows):
            role, text = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, lines, initials))
            if found[at] not in "bd":
                more = found[at] == "t"
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, (*lines, f"{role}:{text}"),
                                      initials + (role[:1] or "?")))
                for new in ("user", "assistant"):
                    heapq.heappush(heap, (cost + 2 + more, audit + "R", at + 1, (*lines, f"{new}:{text}"),
                                          initials + new[0]))
    raise AssertionError


def random_rows(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", "u"]), rng.choice(["Hi.", "no end", "  ", "x? ", "Hi!"]))
            for _ in range(n)]


def test_parse_is_the_cheapest_smallest_audit():
    rng = random.Random(4)
    for _ in range(250):
        rows = random_rows(rng, rng.randint(0, 4))
        cost, audit, lines, found = brute(rows)
        roles, texts = [r for r, _ in rows], [t.encode() for _, t in rows]
        assert cr.faults(roles, texts, set()) == "".join(found)
        assert cr.best(cr.parse([(r[:1], f) for r, f in zip(roles, found, strict=True)]))[:2] == (cost, audit)
        assert cr._lines(cr.replay(audit, 0, roles, texts)).decode() == "\n".join(lines)


def test_stack_reaches_what_the_grammar_reaches():
    for n in range(7):
        for word in map("".join, itertools.product("sua", repeat=n)):
            top = 0
            for symbol in word:
                top = cr.STACKS.push(top, symbol) if top >= 0 else -1
            assert (top >= 0 and cr.STACKS.accepts(top)) == bool(GRAMMAR.match(word))


def expected(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        roles, texts = [r for _, r, _ in turns], [t.encode() for _, _, t in turns]
        found = cr.faults(roles, texts, set())
        cost, audit, _ = cr.best(cr.parse([(r[:1], f) for r, f in zip(roles, found, strict=True)]))
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
        digest = hashlib.sha256(cr._lines(cr.replay(audit, 0, roles, texts))).hexdigest()
        out[conv] = (gaps, *(found.count(k) for k in "bdt"), illegal, cost, audit, digest)
    return out


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], SCHEMA)


def results(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"],
                           r["repaired_sha256"]) for r in df.collect()}


def test_segments_give_what_whole_conversations_give(spark):
    rng = random.Random(3)
    rows = []
    for conv in [*range(30), None]:
        n = 120 if conv in (3, None) else rng.randint(1, 9)
        rows += [(conv, rng.choice([None, i, i, i + 1]), role, text)
                 for i, (role, text) in enumerate(random_rows(rng, n))]
    rows += [(7, None, None, None)] * 2
    assert results(cr.repair(table(spark, rows))) == expected(rows)


def test_long_conversations_span_segments(spark):
    rng = random.Random(8)
    rows = [(1, i, *r) for i, r in enumerate(random_rows(rng, 2600))]
    rows += [(2, i, "user" if i % 2 == 0 else "assistant", f"turn {i}.") for i in range(2300)]
    rows += [(3, 0, "user", "x" * 3_000_000 + "."), (3, 1, "assistant", "y" * 2_000_000), (3, 2, "user", "z.")]
    found = table(spark, rows)
    assert cr.segments(found).where("conv = 1").count() >= 3
    assert results(cr.repair(found)) == expected(rows)


def test_fold_equals_one_parse():
    rng = random.Random(5)
    for _ in range(60):
        rows = random_rows(rng, rng.randint(1, 30))
        roles, texts = [r for r, _ in rows], [t.encode() for _, t in rows]
        found = cr.faults(roles, texts, set())
        steps = [(r[:1], f) for r, f in zip(roles, found, strict=True)]
        fold, plans, at = cr._Fold(1), [], 0
        while at < len(steps):
            size = rng.randint(1, 6)
            cells = [cr.parse(steps[at:at + size], top).get(to, (-1, "")) for top in range(cr.TOPS)
                     for to in range(cr.TOPS)]
            plans += fold.add(list(range(at, at + len(steps[at:at + size]))), [k for k, _ in steps[at:at + size]],
                              found[at:at + size], at, [c for c, _ in cells], [a for _, a in cells])
            at += size
        *rest, summary = fold.end()
        plans += rest
        cost, audit, _ = cr.best(cr.parse(steps))
        assert (summary[-2], summary[-1]) == (cost, audit) and "".join(p[-1] for p in plans) == audit
        assert plans[0][1] == 0


def test_turns_and_edge_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 2, "user", "again"), (2, 0, "assistant", ""), (None, None, None, None)]
    turns = sorted((str(r["conv_id"]), r["sid"], r["place"], r["role"], r["text"])
                   for r in cr.repaired_turns(table(spark, rows)).collect())
    assert [(c, role, text) for c, _, _, role, text in turns] == [
        ("1", "user", "Hi."), ("1", "assistant", "again")]
    assert cr.repair(table(spark, rows)).count() == 3
    assert cr.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_returns_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    convs = spark.read.parquet(f"{sf}/conversations.parquet")
    found = op12_conversation_repair(spark, sf)
    assert found.count() == convs.select("conv_id").distinct().count()
    assert all(re.fullmatch("[KRDI]*", r["audit"]) for r in found.collect())
