import hashlib
import heapq
import random
import re

from nichegrid.llm import conversations
from nichegrid.llm.conversations import CLOSING, STATES, Row, costs_before, damage, damaged_and_repaired, repair, repaired

SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, audit, turns) by trying edits in order of cost and audit; rows are (role, text, fault)."""
    heap = [(0, "", 0, "", ())]
    while True:
        cost, audit, i, initials, turns = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            return cost, audit, list(turns)

        def go(edit, price, j, turn=None, cost=cost, audit=audit, initials=initials, turns=turns):
            new = initials + (turn[0][:1] if turn else "")
            if turn is None or turn[0][:1] and re.fullmatch("s?(ua)*u?", new):
                heapq.heappush(heap, (cost + price, audit + edit, j, new, turns + ((f"{turn[0]}:{turn[1]}",) if turn else ())))

        for role in ("user", "assistant"):
            go("I", 3, i, (role, ""))
        if i < len(rows):
            role, text, fault = rows[i]
            go("D", 4, i + 1)
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault else 0
                go("K", extra, i + 1, (role, text))
                for other in ("user", "assistant"):
                    go("R", 3 + extra, i + 1, (other, text))


def expected(rows):
    """The digest of one conversation; rows are (turn, role, text) in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not last else "duplicate" if (role, text) in seen else None if last[-1] in ".!?" else "truncated")
        seen.add((role, text))
    cost, audit, turns = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
    initials = [r[:1] for _, r, _ in rows]
    at = [t for t, _, _ in rows if t is not None]
    gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def some(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", " "]
    return [(rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(["Yes.", "No", "  ", "", "Well!\n", "A?", "b", f"{rng.random()}."])) for _ in range(n)]


def digests(df):
    return {r["conv_id"]: tuple(r)[1:9] for r in df.collect()}


def test_against_exhaustive_search(spark):
    rng = random.Random(3)
    convs = {i: some(rng, rng.randint(1, 7)) for i in range(150)} | {None: some(rng, 5)}
    df = spark.createDataFrame([(i, *r) for i, rows in convs.items() for r in rows], SCHEMA)
    hashes = {(r["role"], r["text"]): r["h"] for r in df.selectExpr("role", "text", "xxhash64(role, text) as h").distinct().collect()}
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashes[r[1:]], r[1:]))
    want = {i: expected(order(rows)) for i, rows in convs.items()}
    assert digests(repaired(df)) == want
    for size in (1, 3):  # conversations in several chunks
        assert digests(repaired(df, chunk_rows=size)) == want
    turns = {r["conv_id"]: r for r in repaired(df, with_turns=True, chunk_rows=2).collect()}
    for i, r in turns.items():
        assert hashlib.sha256("\n".join(f"{t['role']}:{t['text']}" for t in r["repaired"]).encode()).hexdigest() == want[i][-1]


def test_long_conversation_in_chunks(spark):
    rng = random.Random(4)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), f"{t}{rng.choice(['.', '.', '!', ''])}" if rng.random() < 0.95 else "") for t in range(600)] + [(7, 601, "user", "Again.")] * 500
    rows += [(8, 0, "user", "Hello."), (8, 1, "assistant", "Hello.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    small, large = digests(repaired(df, chunk_rows=16)), digests(repaired(df, chunk_rows=100))
    assert small == large and small[7][2] == 499 and small[7][6].count("D") >= 499
    state, ordered = list(CLOSING), [Row(r[:1], "blank" if not t else None if t[-1] in ".!?" else "truncated", c) for _, _, r, t, c in [(*r, 0) for r in rows[:600]] + [(7, 601, "user", "Again.", 499)]]
    assert costs_before(ordered, state)[0] == small[7][5]


def test_search_uses_what_follows():
    rng = random.Random(5)
    for _ in range(200):
        rows = [Row(rng.choice("suax"), rng.choice([None, None, None, "blank", "truncated"])) for _ in range(rng.randint(0, 6))]
        onward = [rng.randint(0, 9) for _ in STATES]
        exact = costs_before(rows, onward)
        for s in STATES:
            edits, cost, end = repair(rows, s, onward)
            plain = [onward[s]] if not rows else [exact[s]]
            assert cost + onward[end] == plain[0]


def test_damage(spark):
    rows = [(c, t, "assistant", f"Text {t}. Yes?!") for c in range(40) for t in range(8)] + [(None, None, None, None)]
    got = damage(spark.createDataFrame(rows, SCHEMA)).collect()
    import zlib

    want = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        if k:
            row = (c, t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
            want += [row, row] if k == 3 else [row]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_edge_cases(spark):
    rows = [(None, 1, "user", "Hello."), (None, None, None, None), (1, 2, None, "x"), (1, 2, "user", None), (2, 1, "user", "word " * 300_000 + "."), (2, 2, "assistant", "x" * 2_000_000)]
    df = spark.createDataFrame([(*r, 5, "a", 1) for r in rows], SCHEMA + ", n long, part string, h int")
    got = digests(repaired(df))
    assert got[None][:7] == (0, 1, 0, 0, 1, 7, "DKI") and got[2][:7] == (0, 0, 0, 1, 0, 3, "KK")
    assert got[1][:4] == (0, 1, 0, 1)
    assert repaired(df.limit(0)).collect() == []
    dropped = [(c, 0, "user", "Hello.") for c in range(60)]
    all_of = digests(damaged_and_repaired(spark.createDataFrame(dropped, SCHEMA)))
    assert len(all_of) == 60 and (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) in all_of.values()
    assert conversations.repair([]) == ([], 0, conversations.START)
