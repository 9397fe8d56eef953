import hashlib
import random
import zlib

import pytest

from strideframe.llm import conversation_trie
from strideframe.llm.conversation_trie import SearchTree


def brute(turns):
    """Nodes straight from the definition: {(conv_id, depth): rest}."""
    own = {}
    for c, turn, role, text in turns:
        if c is not None:
            digest = hashlib.sha256((text or "").encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, role or "", digest), (role or "", text or "")))
    own = {c: [t for _, t in sorted(rows)] for c, rows in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        rest = abs(c) % 5 * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(c - rest, [])[:h] + own[c][h:])
    nodes = {}
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    out = {}
    for prefix, members in nodes.items():
        below = [p for p in nodes if p[: len(prefix)] == prefix]
        children = [p for p in below if len(p) == len(prefix) + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(prefix))
        parent = min(nodes[prefix[:-1]]) if prefix else None
        key = (min(members), len(prefix))
        assert key not in out
        out[key] = (parent, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def result(df):
    rows = df.collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    return found


def table(spark, turns):
    return spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")


def sample(seed, n=90):
    rng = random.Random(seed)
    turns = []
    for c in range(n):
        for t in range(rng.choice([1, 2, 3, 5, 12])):
            turns.append((c, t, rng.choice(["user", "user", "bot"]), rng.choice(["hello", "hi é", "one more", f"own {c % 4}"])))
    return turns


@pytest.mark.parametrize(("shard_turns", "pack"), [(1 << 17, 1 << 12), (40, 2), (1, 1)])
def test_matches_brute_force_over_one_and_many_shards(spark, shard_turns, pack):
    turns = sample(shard_turns)
    assert result(conversation_trie.prefix_trie(table(spark, turns), shard_turns, pack)) == brute(turns)


def test_hot_conversation_and_hot_first_turn(spark):
    turns = [(c, t, "user", x) for c in range(150) for t, x in enumerate(["same", "and same"])]
    turns += [(c, t, "user", x) for c in range(150, 260) for t, x in enumerate(["same", f"own {c}", f"tail {c % 3}"])]
    assert result(conversation_trie.prefix_trie(table(spark, turns), 60, 16)) == brute(turns)


def test_odd_turns(spark):
    long = "long text " * 40_000
    turns = [
        (None, 1, "user", "no conversation"), (5, None, None, None), (5, 1, "user", ""), (5, 1, "user", ""), (5, 1, "bot", "tie b"), (5, 1, "bot", "tie a"),
        (7, 3, "user", long), (7, None, "user", "first"), (-3, 1, "user", "negative"), (-5, 1, None, "base"), (9, 1, "user", "few"), (12, 4, "x", None),
        (9_000_000_000, 1, "user", "large id"),
    ]
    extra = table(spark, turns).selectExpr("*", "1 as id", "'s' as seq", "2 as digest", "3 as _base", "4 as shard", "5 as path")
    assert result(conversation_trie.prefix_trie(extra, 2, 1)) == brute(turns)


def test_deep_conversation(spark):
    turns = [(c, t, "user", f"turn {t}" if t < 300 else f"turn {t} of {c}") for c in (0, 5, 10) for t in range(400)]
    assert result(conversation_trie.prefix_trie(table(spark, turns), 500)) == brute(turns)


def test_no_conversations_no_nodes(spark):
    assert conversation_trie.prefix_trie(table(spark, [])).count() == 0
    assert conversation_trie.prefix_trie(table(spark, [(None, 1, "a", "b")])).count() == 0


def test_tree_holds_what_was_inserted():
    rng = random.Random(5)
    seqs = sorted({tuple(rng.randint(0, 9) for _ in range(rng.randint(0, 6))) for _ in range(400)})
    tree, ends = SearchTree.balanced(seqs, seqs)
    assert [tuple(tree.key[n] for n in tree.path(e)[1:]) for e in ends] == seqs
    assert len(tree.key) == len({s[:d] for s in seqs for d in range(len(s) + 1)})
    assert all(tree.parent[n] < n for n in range(1, len(tree.key)))
