import hashlib
import random
import re
import zlib
from collections import defaultdict

from tidemark.llm import conversation_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, place string, `_range` string, depth string, owner string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(data: list[tuple], splice: int = 20, variants: int = 4) -> list[tuple]:
    turns = defaultdict(list)
    for c, t, r, x in data:
        if c is not None:
            r, x = r or "", x or ""
            turns[c].append(((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()), (r, x)))
    turns = {c: [v for _, v in sorted(q)] for c, q in turns.items()}
    seqs = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % variants if splice else 0
        seqs[c] = tuple((turns.get(c - c % splice, [])[:h] if splice else []) + own[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[seqs[c][:d]].append(c)
            if d:
                children[seqs[c][: d - 1]].add(seqs[c][:d])
        ends[seqs[c]].append(c)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = ((len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0) + sum(saved[k] for k in children[p])
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()))
    return sorted(out)


def check(spark, data: list[tuple], **how):
    frame = spark.createDataFrame([(*r, "x", None, "y", "z") for r in data], SCHEMA).repartition(4)
    got = sorted(tuple(r[c] for c in COLUMNS) for r in conversation_trie.conversation_tree(frame, **how).collect())
    assert got == brute(data, how.get("splice", 0))
    return got


def conversations(seed: int, n: int) -> list[tuple]:
    rnd, out = random.Random(seed), []
    for c in range(n):
        for t in range(rnd.choice((0, 1, 2, 3, 5, 7))):
            out.append((c, t, rnd.choice(("user", "assistant")) if t > 2 else "user", " ".join(rnd.choice(("yes", "no x", "")) for _ in range(2))))
    return out


def test_spliced_conversations(spark):
    got = check(spark, conversations(1, 130), splice=20)
    assert got[0][:3] == (0, 0, None) and max(r[3] for r in got) > 100


def test_odd_rows(spark):
    data = conversations(2, 30)
    data += [(None, 0, "user", "lost"), (3, None, None, None), (3, None, "", ""), (5, 1, "user", "same"), (5, 1, "user", "same"), (5, 1, "a", "buser"), (5, 1, "ab", "user"), (-3, 0, "user", "yes no x"), (1000, 5, "user", "one \t\v two")]
    check(spark, data)
    check(spark, data, splice=20)
    assert check(spark, [(41, 0, "user", "all of it goes")], splice=20)[0][1] == 0
    check(spark, [])


def test_one_conversation_holds_most_rows(spark):
    long = [(7, t, "user", f"t{t} word") for t in range(700)]
    other = [(c, t, "user", f"t{t} word") for c in range(8, 14) for t in range(c * 20)]
    check(spark, long + other)


def test_chains_hang_on_chains(spark):
    """Conversation c leaves that of c - 1 one turn later than that left its own."""
    data = [(c, t, "user", f"m{min(t, c)} x{t >= c} {t}") for c in range(40) for t in range(c + 2)]
    check(spark, data)


def test_ids_of_a_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "JOINED", 3)
    check(spark, [(c, 0, "user", "hello") for c in range(50)] + [(c, 0, "user", "bye") for c in range(50, 55)])
