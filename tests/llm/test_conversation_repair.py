import hashlib
import itertools
import random
import re
import zlib

import pytest

from optika.llm import conversation_repair as cr
from optika.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]")


def faults(rows):
    """(fault, role, text) of rows in order."""
    seen, out = set(), []
    for role, text in rows:
        found = WORD.findall(text)
        out.append("blank" if not found else "duplicate" if (role, text) in seen else "truncated" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit) with the repaired rows, by Dijkstra's order over whole edit strings: no layers, no places."""
    import heapq

    f, name = faults(rows), {"u": "user", "a": "assistant"}
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, kept = heapq.heappop(heap)
        if i == len(rows) and state in ("", "a"):
            return cost, audit, kept
        if (i, state) in done:
            continue
        done.add((i, state))
        for r in "ua":
            if r in after[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, r, (*kept, (name[r], ""))))
        if i < len(rows):
            role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, kept))
            if f[i] not in ("blank", "duplicate"):
                more = f[i] == "truncated"
                if role[:1] in after[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*kept, (role, text))))
                for r in "ua":
                    if r in after[state]:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, r, (*kept, (name[r], text))))


def exhaustive(symbols):
    """Least (cost, audit) of a short signature by trying all edit strings with at most two insertions anywhere."""
    best = None
    for gaps in itertools.product(*[["", "u", "a", "ua", "au"]] * (len(symbols) + 1)):
        for edits in itertools.product("DKua", repeat=len(symbols)):
            cost, audit, roles = 2 * len(gaps[0]), "I" * len(gaps[0]), gaps[0]
            for x, e, g in zip(symbols, edits, gaps[1:], strict=True):
                if e == "D":
                    cost, audit = cost + 3, audit + "D"
                elif x == "x" or e == "K" and x.lower() == "o":
                    break
                else:
                    cost, audit, roles = cost + (2 if e in "ua" else 0) + x.isupper(), audit + ("R" if e in "ua" else "K"), roles + (x.lower() if e == "K" else e)
                cost, audit, roles = cost + 2 * len(g), audit + "I" * len(g), roles + g
            else:
                if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def test_answers_against_all_edits():
    trie = cr.Trie()
    for s in sorted("".join(x) for n in range(3) for x in itertools.product("suaoSUAOx", repeat=n)):
        assert trie.answer(s) == exhaustive(s), s


def test_prefixes_are_computed_once():
    """A signature's answer does not depend on what came before it, and layers are shared with it."""
    rng = random.Random(5)
    some = sorted({"".join(rng.choice("uaUAxso") for _ in range(rng.randint(0, 30))) for _ in range(300)} | {"ua" * 20 + x for x in ("", "u", "x", "xa")})
    trie, layers = cr.Trie(), 0
    for s in some:
        assert trie.answer(s) == cr.Trie().answer(s)
        layers += trie.computed
    nodes = {s[:i] for s in some for i in range(1, len(s) + 1)}
    assert layers == len(nodes)


def damage(rows):
    out, known = {}, lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        k = zlib.crc32(f"{known(conv)}:{known(turn)}".encode()) % 20
        role, text = known(role), known(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        kept += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def told(rows):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).hexdigest()[:32])
    rows = sorted(rows, key=key)
    turns, f = {t for t, *_ in rows if t is not None}, faults([r[1:] for r in rows])
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, kept = cheapest([r[1:] for r in rows])
    text = "\n".join(f"{a}:{b}" for a, b in kept)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(f.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_brute_force(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = {c: told(x) for c, x in damage(rows).items()}
    got = QUERIES["op11_conversation_repair"](spark, d).collect()
    assert len(got) == len(want) and {r["conv_id"]: (*(r[c] for c in FIELDS), r["repaired_sha256"]) for r in got} == want


def hard_rows():
    rng = random.Random(8)
    rows = [
        (1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, None, None), (2, None, "assistant", "x"), (2, None, "system", "Be good."), (2, 5, "tool", "{}"), (None, 1, "user", "null conversation?"),
        (None, None, None, None), (3, 1, "", ""), (3, 1, "user", " \t\r\n"), (4, 7, "user", "long " * 300_000 + "end."), (4, 8, "assistant", "Yes."), (4, 8, "assistant", "Yes."), (5, 1, "user", "Ü  no end"),
        (5, -(1 << 63), "assistant", "first."), (5, (1 << 63) - 1, "assistant", "last!\n\n"), (6, 1, "user", "a.\u0085"),
    ]
    rows += [(7, i // 2, rng.choice(["user", "assistant", "system", "other"]), rng.choice(["a.", "b", "", "c?", "d!"]) + str(i % 9)) for i in range(600)]
    return rows + [(8, i, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(3000)]


def test_hard_rows(spark):
    extra = (9, "x", 1, "s", 2, 0.5, "k", "h", True)
    schema = "conv_id long, turn long, role string, text string, n long, signature string, cost long, audit string, position long, _side double, copy string, _hash string, fault boolean"
    rows = hard_rows()
    df = spark.createDataFrame([(*r, *extra) for r in rows], schema)
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    want = {c: told(x) for c, x in groups.items()}
    verdicts, repaired = cr.repair_conversations(df)
    got = {r["conv_id"]: tuple(r[c] for c in FIELDS) for r in verdicts.collect()}
    want[5] = (0, *want[5][1:])  # no long holds this distance
    assert got == {c: x[:7] for c, x in want.items()}
    lines = {}
    for r in repaired.collect():
        lines.setdefault(r["conv_id"], []).append((r["position"], f"{r['role']}:{r['text']}"))
    for c, x in want.items():
        assert [n for n, _ in lines.get(c, [])] == list(range(len(lines.get(c, []))))
        assert hashlib.sha256("\n".join(t for _, t in lines.get(c, [])).encode()).hexdigest() == x[7]
    verdicts, repaired = cr.repair_conversations(df.limit(0))
    assert verdicts.count() == repaired.count() == 0
    assert repaired.columns == ["conv_id", "position", "edit", "role", "text"]


def test_query_on_hard_rows(spark, tmp_path):
    rows = [r for r in hard_rows() if r[0] != 5] + [(k, 0, "user", "gone?") for k in range(100, 140)]
    spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, kind long").write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()
    want = {c: told(x) for c, x in damage(rows).items()}
    assert {r["conv_id"]: (*(r[c] for c in FIELDS), r["repaired_sha256"]) for r in got} == want and len(got) == len(want)
    assert any(not x for x in damage(rows).values())
    empty = tmp_path / "none"
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{empty}/conversations.parquet")
    assert QUERIES["op11_conversation_repair"](spark, str(empty)).count() == 0
