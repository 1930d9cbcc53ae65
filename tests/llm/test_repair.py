"""Operator 11: repair of conversations, against plain programmes over strings."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from oracle import assert_same, connect
from strandworks.llm import common, queries, repair

GOAL = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """(cost, audit) of rows (initial, gone, truncated): one programme over whole strings."""
    into = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}

    def least(options):
        out = {}
        for state, cost, audit in options:
            if state not in out or (cost, audit) < out[state]:
                out[state] = cost, audit
        return out

    def inserted(best):
        for _ in range(4):
            best = least([*((s, *v) for s, v in best.items()), *((t, best[s][0] + 3, best[s][1] + "I") for r in "ua" for s, t in into[r] if s in best)])
        return best

    best = inserted({0: (0, "")})
    for initial, gone, truncated in rows:
        options = [(s, c + 4, a + "D") for s, (c, a) in best.items()]
        if not gone:
            options += [(t, best[s][0] + 3 + 3 * truncated, best[s][1] + "R") for r in "ua" for s, t in into[r] if s in best]
            options += [(t, best[s][0] + 3 * truncated, best[s][1] + "K") for s, t in into.get(initial, []) if s in best]
        best = inserted(least(options))
    return min(best[s] for s in (0, 3) if s in best)


def exhausted(rows):
    """The same by trying all edits with at most three inserted rows between two."""
    gaps = ["", "u", "a", "ua", "au", "uau", "aua"]
    found = []
    for edits in product(*([("D",), ("R", "u"), ("R", "a"), ("K",)] for _ in rows)):
        if any(r[1] and e[0] != "D" for r, e in zip(rows, edits)):
            continue
        own = ["" if e[0] == "D" else (r[0] or "?") if e[0] == "K" else e[1] for r, e in zip(rows, edits)]
        base = sum({"D": 4, "K": 0, "R": 3}[e[0]] + 3 * (r[2] and e[0] != "D") for r, e in zip(rows, edits))
        for between in product(gaps, repeat=len(rows) + 1):
            roles = "".join(g + o for g, o in zip(between, [*own, ""]))
            if GOAL.match(roles):
                found.append((base + 3 * sum(map(len, between)), "".join("I" * len(g) + e for g, e in zip(between, [*(e[0] for e in edits), ""]))))
    return min(found)


def some_rows(rng, n):
    return [(rng.choice(["s", "u", "a", "u", "a", "t", ""]), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


def programme(rows, prime=repair.PRIME, every=0):
    now, out = repair.Repair(repair.Audits(prime)), ""
    for k, row in enumerate(rows):
        now.row(*row)
        if every and k % every == 0:
            out += now.agreed()
    cost, rest = now.last()
    return cost, out + rest


def test_plain_programme_finds_the_cheapest():
    rng = random.Random(1)
    for _ in range(25):
        rows = some_rows(rng, rng.randrange(4))
        assert cheapest(rows) == exhausted(rows)


@pytest.mark.parametrize("prime", [repair.PRIME, 2, 3, 7])
def test_programme(prime):
    """Small primes make hashes collide all the time."""
    rng = random.Random(2)
    for _ in range(400):
        rows = some_rows(rng, rng.randrange(30))
        assert programme(rows, prime) == cheapest(rows)
    rows = some_rows(rng, 2000)
    assert programme(rows, prime) == cheapest(rows)


@pytest.mark.parametrize("every", [1, 3, 10])
def test_what_is_agreed_on_is_final(every):
    rng = random.Random(3)
    for _ in range(200):
        rows = some_rows(rng, rng.randrange(40))
        assert programme(rows, every=every) == cheapest(rows)


def test_prefixes():
    rng = random.Random(4)
    for prime in (repair.PRIME, 2, 5):
        audits, texts = repair.Audits(prime), [""]
        for _ in range(600):
            at = rng.randrange(max(0, len(texts) - 30), len(texts))
            char = rng.choice("DIKR")
            assert audits.add(at, char) == len(texts)
            texts.append(texts[at] + char)
        for _ in range(3000):
            a, b = rng.randrange(len(texts)), rng.randrange(len(texts))
            n = 0
            while n < min(len(texts[a]), len(texts[b])) and texts[a][n] == texts[b][n]:
                n += 1
            assert audits.common_prefix(a, b) == n and audits.text(a) == texts[a]
            assert audits.less(a, b) == (texts[a] < texts[b])


def damage(rows):
    """Rows (conv_id, turn, role, text) by conversation, damaged and in order."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def expected(rows):
    out = []
    for conv, own in damage(rows).items():
        seen, faults = set(), []
        for _, role, text in own:
            words = re.sub(r"[\x20\x09-\x0D]+", "", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None)
            seen.add((role, text))
        cost, audit = cheapest([(role[:1], f in ("blank", "duplicate"), f == "truncated") for (_, role, _), f in zip(own, faults)])
        roles, k = [], 0
        for edit in audit:
            if edit != "D":
                roles.append((own[k][1], own[k][2]) if edit == "K" else (None, "" if edit == "I" else own[k][2]))
            k += edit != "I"
        system = bool(roles) and (roles[0][0] or "")[:1] == "s"
        named = [(r or ("assistant" if (i - system) % 2 else "user"), t) for i, (r, t) in enumerate(roles)]
        turns = {t for t, *_ in own if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in named).encode()).hexdigest()))
    return sorted(out, key=str)


def asked(spark, folder):
    got = queries.QUERIES["op11_repair"](spark, folder)
    return sorted((tuple(r[c] for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got.collect()), key=str)


def test_query(spark, small):
    rows = [tuple(r) for r in common.table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert asked(spark, small) == expected(rows)


def test_oracle(spark, small):
    assert_same(queries.QUERIES["op11_repair"](spark, small), connect(small), queries.ORACLE_SQL["op11_repair"])


@pytest.mark.parametrize("held", [repair.HELD_ROWS, 2])
def test_odd_conversations(spark, tmp_path, monkeypatch, held):
    monkeypatch.setattr(repair.repaired, "__defaults__", (repair.PRIME, held, repair.HELD_BYTES))
    rng = random.Random(5)
    texts = ["Yes.", "no", " \t\n", "", None, "Why?\n", "é …", "x" * 300_000 + ".", "what!\x0b ", "a.\x85"]
    roles = ["user", "assistant", "system", "student", "tool", "", None, "ünknown", "assist"]
    rows = [(rng.choice([None, 1, 2, 3, -7, 2**62]), rng.choice([None, *range(8), -3, 2**40]), rng.choice(roles[: rng.choice([3, 9])]), rng.choice(texts)) for _ in range(300)]
    rows += [(50 + k, k, "user", "Yes.") for k in range(60)]  # some lose all their rows
    rows += [(None, k, ["user", "assistant"][k % 2], f"Turn {k}.") for k in range(700)]
    rows += [(900, 5, "user", "same.")] * 40 + [(901, -(2**63), "user", "a."), (901, 2**63 - 1, "assistant", "b.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("place", "fault", "times", "step", "edit")})
    df.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    want = [(*w[:1], w[1] if w[1] < 1 << 63 else None, *w[2:]) for w in expected(rows)]
    assert asked(spark, str(tmp_path)) == sorted(want, key=str)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert asked(spark, str(tmp_path)) == []


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hello?"), (1, 3, "assistant", None), (1, 4, "assistant", "Yes."), (2, 0, "assistant", "Alone.")]
    got = repair.repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("conv_id", "step").collect()
    assert [tuple(r) for r in got] == [
        (1, 0, "K", 0, None, "system", "Be kind."),
        (1, 1, "K", 1, None, "user", "Hi."),
        (1, 2, "I", None, None, "assistant", ""),
        (1, 3, "K", 2, None, "user", "Hello?"),
        (1, 4, "D", 3, "blank", None, None),
        (1, 5, "K", 4, None, "assistant", "Yes."),
        (2, 0, "I", None, None, "user", ""),
        (2, 1, "K", 0, None, "assistant", "Alone."),
    ]


def test_rows_held_are_few():
    """A long conversation's rows are given out as they come."""
    rng = random.Random(6)
    came = 0

    def rows():
        nonlocal came
        for k in range(20_000):
            came += 1
            yield {"conv_id": 1, "place": 1, "turn": k, "role": rng.choice(["user", "assistant", "system"]), "text": "t.", "fault": rng.choice([None, None, "truncated", "blank"])}

    given = most = 0
    for kind, _, edit, row, _, _ in repair.repaired(rows()):
        given += row is not None
        most = max(most, came - given)
    assert given == came == 20_000 and most <= 2 * repair.HELD_ROWS
