"""The prefix trie against brute force: shared heads, long conversations over many blocks, nulls, ties, repeated rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from framelake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, total int, b string"


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            digest = hashlib.sha256(f"{len(r.encode())}:{r}{t}".encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0), f"{digest}:{len(re.findall(r'[^\x20\x09-\x0d]+', t))}", (r, t)))
    order = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in order:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(abs(c) % 20 * (1 if c > 0 else -1))
        out[c] = order.get(base, [])[:h] + order[c][h:]
    return out


def brute(rows):
    convs = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(list)
    for node in members:
        if node:
            kids[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0d]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(m) - 1) * words
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids[n]), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in list(members.items()))


def found(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(*r, "x", 5, "y") for r in rows], schema).repartition(6)
    out = prefix_trie.prefix_trie(prefix_trie.share_heads(prefix_trie.number_turns(prefix_trie.turn_keys(df))))
    return sorted(map(tuple, out.collect()))


def key(row):
    return tuple((v is not None, v) for v in row)


ROWS = [(c, t, "user" if t % 2 else "system", f"turn {t} of {c % 3 if t < 5 else c % 7}") for c in range(60) for t in range(c % 9)]
ROWS += [(c, t, "user", f"very long {t}" if t < 30 + c % 11 * 9 else f"own {c} {t}") for c in (100, 101, 102, 111, 119, 120, 133, 140) for t in range(20 + c)]
ROWS += [(200, None, "a", "null turn"), (200, 1, None, None), (200, 1, "z", "tie"), (200, 1, "b", "tie"), (200, 1, "b", "tie"), (201, 0, "a", ""), (202, 3, "", "a"),
         (None, 1, "a", "no id"), (-5, 0, "u", "minus"), (-5, 1, "u", "minus two"), (2**40 + 3, 0, "u", "w " * 50_000), (2**40, 0, "u", "w " * 50_000)]


@pytest.mark.parametrize("fan", [2, 16])
def test_trie_is_that_of_brute_force(spark, monkeypatch, fan):
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    monkeypatch.setattr(prefix_trie, "PIECE", 16)
    assert sorted(found(spark, ROWS), key=key) == sorted(brute(ROWS), key=key)


def test_one_conversation_in_every_row_and_none(spark):
    rows = [(c, t, "u", f"same {t}") for c in range(0, 400, 20) for t in range(17)]
    got = found(spark, rows)
    assert sorted(got, key=key) == sorted(brute(rows), key=key) and len(got) == 18
    assert found(spark, []) == []


def test_matches_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    df = prefix_trie.op11_prefix_trie(spark, "/root/testdata/sf0.01")
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({prefix_trie.ORACLE_SQL})").fetchall()
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key) and len(want) > 100
