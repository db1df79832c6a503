"""Repair and trie of conversations against plain Python, on the tables and on awkward rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from seamline.llm import conversation_repair as repair
from seamline.llm import conversation_trie as trie
from seamline.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "extra string, conv_id long, turn long, role string, text string, tie string"


def rows_at(sf_dir):
    from .brute import table

    return table(sf_dir, "conversations", "conv_id, turn, role, text")


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[3]))


def cheapest(rows):
    """All (cost, audit, repaired roles) by a plain recursion over strings; rows: role, text, must
    be deleted, cut off. Insertions are bounded, for three in a row never pay."""
    best = {}

    def ends(state):
        return state in (0, 3)

    def go(state, s):
        return repair.GRAMMAR.get((state, s))

    def run(i, state, inserts):
        key = i, state, inserts
        if key not in best:
            found = [(0, "")] if i == len(rows) and ends(state) else []
            if inserts < 3:
                found += [(3 + c, "I" + a) for s in "ua" if go(state, s) is not None for c, a in [run(i, go(state, s), inserts + 1)]]
            if i < len(rows):
                role, _, gone, cut = rows[i]
                c, a = run(i + 1, state, 0)
                found.append((4 + c, "D" + a))
                if not gone:
                    for label, cost, s in (("K", 0, role[:1]), ("R", 3, "u"), ("R", 3, "a")):
                        if (s or "?") in "sua" and go(state, s) is not None:
                            c, a = run(i + 1, go(state, s), 0)
                            found.append((cost + 3 * cut + c, label + a))
            best[key] = min(found, default=(1 << 40, "~"))
        return best[key]

    for i in reversed(range(len(rows))):  # from the end, so that the recursion stays shallow
        for state in range(4):
            run(i, state, 0)
    return run(0, 0, 0)


def expected_repairs(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        convs[conv].append((turn, role, text, digest(role, text)))
    out = {}
    for conv, own in convs.items():
        damaged = []
        for turn, role, text, tie in in_order(own):
            hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            damaged += [(turn, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
        seen, judged, counts = set(), [], defaultdict(int)
        for turn, role, text in damaged:
            words = re.sub(r"[\x20\x09-\x0D]+$", "", text)
            fault = "blank" if not WORD.search(text) else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [t for t, _, _ in damaged if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit = cheapest(judged)
        repaired, k, state = [], 0, 0
        for edit in audit:
            role, text = ("user" if state in (0, 1, 3) else "assistant"), ""
            if edit != "I":
                role, text = judged[k][0] if edit == "K" else role, judged[k][1]
                k += 1
            if edit != "D":
                repaired.append(f"{role}:{text}")
                state = repair.GRAMMAR[state, role[0]]
        assert state in (0, 3)
        out[conv] = gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()
    return out


def repaired(df):
    rows = [tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r[1:] for r in rows}


def expected_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn, role or "", text or "", digest(role or "", text or "")))
    own = {c: [(r, t) for _, r, t, _ in in_order(x)] for c, x in own.items()}
    members = defaultdict(list)
    for c in own:
        head = zlib.crc32(str(c).encode()) % 4
        way = own.get(c - c % 20, [])[:head] + own[c][head:]
        for d in range(len(way) + 1):
            members[tuple(way[:d])].append((c, len(way)))
    children = defaultdict(list)
    for way in members:
        if way:
            children[way[:-1]].append(way)
    sums = {}
    for way in sorted(members, key=len, reverse=True):
        below = [sums[c] for c in children[way]]
        own_tokens = (len(members[way]) - 1) * len(WORD.findall(way[-1][1])) if way else 0
        sums[way] = sum(b[0] for b in below) or 1, own_tokens + sum(b[1] for b in below)
    name = {way: min(m)[0] for way, m in members.items()}
    return sorted(
        (name[w], len(w), name[w[:-1]] if w else -1, len(m), len(children[w]), *sums[w], hashlib.sha256(",".join(str(c) for c in sorted(c for c, n in m if n == len(w))).encode()).hexdigest())
        for w, m in members.items()
    )


def nodes(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def awkward():
    """Nulls, blanks, ties, repeated rows, odd roles, a long text, copies of a long conversation."""
    rows = [
        (1, 0, "user", "Hello."), (1, 1, "assistant", None), (1, None, "user", "First?"), (1, 1, "assistant", "Yes!"), (1, 1, "assistant", "Yes!"), (1, 1, "user", "Yes!"), (2, 5, None, "x"), (2, 9, "tool", "y."), (3, None, None, None),
        (4, 0, "", ""), (4, 1, "u", "\t "), (4, 2, "system", "A " * 40_000 + "."), (None, 1, "user", "no id."), (None, None, "assistant", "no id"), (7, -3, "assistant", "Ünï. \n"), (7, 4, "assistant", "Ünï"), (7, 4, "system", "late."), (21, 0, "system", "s."),
        (21, 1, "user", "q?"), (22, 0, "user", "other"), (-5, 0, "user", "negative."), (-25, 0, "user", "negative."), (60, 0, "user", "top."), (60, 0, "user", "top."), (60, 0, "user", "top."), (60, 1, "user", "top."), (60, 2, "user", "b"), (61, 3, "user", "b"),
    ]
    for conv in (40, 41, 47, 59, 300, 301):  # levels far beyond the first block
        rows += [(conv, t, ("user", "assistant")[t % 2], f"turn {t % 7}{'.' if t % 5 else ''}") for t in range(30 + conv % 4)]
    rows += [(conv, 0, "user", "the same.") for conv in range(1000, 1300)]  # a third of all rows begin alike
    rows += [(5000, t % 50, ("user", "assistant", "system")[t % 3], f"row {t // 2}") for t in range(400)]  # a long one with ties
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([("e", *r, "clash") for r in awkward()], SCHEMA).repartition(5)


def as_query(spark, f, df, tmp_path):
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    return f(spark, str(tmp_path))


def test_repair_of_the_table(spark, sf_dir):
    assert repaired(queries.op11_conversation_repair(spark, sf_dir)) == expected_repairs(rows_at(sf_dir))


def test_repair_of_awkward_rows(spark, odd, tmp_path):
    assert repaired(as_query(spark, queries.op11_conversation_repair, odd, tmp_path)) == expected_repairs(awkward())


def test_shortest_repairs_are_the_least_of_all():
    import itertools

    names = {0: "system", 1: "user", 2: "assistant", 3: "tool"}
    symbols = [k | f for k in range(4) for f in (0, repair.TRUNCATED)] + [repair.BLANK, 1 | repair.DUPLICATE]
    for n in range(4):
        for word in itertools.product(symbols, repeat=n):
            rows = [(names[s & 3], "", bool(s & (repair.BLANK | repair.DUPLICATE)), bool(s & repair.TRUNCATED)) for s in word]
            assert repair.shortest_repair(bytes(word)) == cheapest(rows), word


def test_repaired_turns_fit_the_grammar(spark, odd):
    rows = repair.damaged(odd)
    turns = repair.repaired_turns(rows, repair.plan_repairs(rows))
    found = defaultdict(list)
    for r in turns.collect():
        found[r["conv_id"]].append(r)
    for own in found.values():
        own.sort(key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in own))
        assert all(r["text"] == "" for r in own if r["edit"] == "I")


def test_trie_of_the_table(spark, sf_dir):
    assert nodes(queries.op12_conversation_trie(spark, sf_dir)) == expected_trie(rows_at(sf_dir))


def test_trie_of_awkward_rows(spark, odd, tmp_path):
    assert nodes(as_query(spark, queries.op12_conversation_trie, odd, tmp_path)) == expected_trie(awkward())


def test_blocks_never_change_the_trie(spark, odd):
    from pyspark.sql import functions as F

    turns = trie.numbered_turns(odd.filter("conv_id < 100"))
    conv = F.col("conv_id")
    parts = trie.rebuilt_turns(turns, conv - conv % 20, F.crc32(conv.cast("string")) % 4)
    want = expected_trie([r for r in awkward() if r[0] is not None and r[0] < 100])
    assert nodes(trie.prefix_trie(*parts, first_levels=3, most_levels=5)) == want


def test_conversations_without_rows(spark, odd, tmp_path):
    none = odd.filter("false")
    none.write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op11_conversation_repair(spark, str(tmp_path)).count() == 0
    assert queries.op12_conversation_trie(spark, str(tmp_path)).count() == 0


def test_a_single_conversation(spark):
    turns = spark.createDataFrame([(3, 1, b"a", 2), (3, 2, b"b", 1)], trie.TURNS)
    got = nodes(trie.prefix_trie(turns, spark.createDataFrame([(3, 2)], "conv_id long, size long")))
    assert [g[:7] for g in got] == [(3, 0, -1, 1, 1, 1, 0), (3, 1, 3, 1, 1, 1, 0), (3, 2, 3, 1, 0, 1, 0)]
