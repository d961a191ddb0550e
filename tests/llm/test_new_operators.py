"""The n-gram join, the filter audit and the prefix trie, against brute force on small fixtures."""

import hashlib
import random
import re
import zlib
from itertools import combinations, permutations

import pytest

from feedweave.llm import filter_audit, ngram_join, prefix_trie

DOCS = "doc_id long, text string, id string, cid string, n string"


# N-gram join


def grams(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute_join(rows, size=4, threshold=85):
    sets = [grams(t, size) for _, t in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            links[i] += 1
            links[j] += 1
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(sets[i]), None if k is None else least[find(i)], links[i]) for i, (k, _) in enumerate(rows)), key=repr)


def joined(spark, rows, **more):
    df = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in rows], DOCS)
    return sorted((tuple(r) for r in ngram_join.similar(df, **more).collect()), key=repr)


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at : at + (kind != 1)] = [] if kind == 0 else [f"e{rng.randrange(10**6)}"]
    return " ".join(words)


def families(rng):
    """Copies at many distances, one passage in a third of the rows, and a template."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = []
    for base in range(6):
        words = [f"b{base}w{rng.randrange(300)}" for _ in range(rng.choice([8, 60, 200]))]
        rows += [edited(rng, words, rng.randrange(1 + len(words) // 12)) for _ in range(25)]
    rows += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(100))) for _ in range(60)]
    template = [f"t{i}" for i in range(150)]
    rows += [" ".join([*template, *(f"s{rng.randrange(10**6)}" for _ in range(rng.randrange(18, 30)))]) for _ in range(60)]
    rows += ["same words in all of these rows"] * 40
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("leaf", [8, 512])
def test_join_equals_brute_force(spark, leaf):
    rows = families(random.Random(3))
    want = brute_join(rows)
    assert sum(w[3] for w in want) > 2000
    assert joined(spark, rows, leaf=leaf) == want


def test_join_of_a_template_below_the_threshold(spark):
    rng = random.Random(8)
    template = [f"t{i}" for i in range(160)]
    rows = [(i, " ".join([*template, *(f"s{rng.randrange(40)}" for _ in range(rng.randrange(14, 22)))])) for i in range(300)]
    assert joined(spark, rows, leaf=64) == brute_join(rows)


def test_join_with_other_sizes_and_thresholds(spark):
    rows = families(random.Random(5))[:150]
    for size, threshold in ((2, 60), (5, 100)):
        assert joined(spark, rows, size=size, threshold=threshold, leaf=16) == brute_join(rows, size, threshold)


def test_join_of_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (None, "one"), (6, "a b"), (6, "a b"), (6, "c d e f g"), (7, "C D e f\x0bg"), (8, long), (9, long + " end"), (None, None), (-5, "ÜBER a")]
    assert joined(spark, rows) == brute_join(rows)
    assert joined(spark, []) == []


def test_cells_hold_the_partners_of_their_inner_members():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    base = [rng.integers(0, 1 << 62, 60, dtype=np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([rng.choice(base[i % 4], 50, replace=False), rng.integers(0, 1 << 62, rng.integers(0, 9), dtype=np.uint64)])) for i in range(80)]
    rows = pa.table({"region": [7] * 80, "path": [0] * 80, "cid": range(80), "n": [len(s) for s in sets], "inner": [True] * 80, "words": [s.tobytes() for s in sets]})
    out = ngram_join._cells(85)(None, rows, rows.take([0, 1, 2, 3, 9]).select(["cid", "n", "words"])).to_pylist()
    cell = {r["cid"]: r["cell"] for r in out if r["inner"]}
    inside = {(r["cell"], r["cid"]) for r in out}
    assert len(cell) == 80 and len(inside) < 5 * 80
    for i, j in combinations(range(80), 2):
        both = len(np.intersect1d(sets[i], sets[j]))
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            assert (cell[i], j) in inside and (cell[j], i) in inside


# Filter audit


def brute_audit(docs, labels):
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for k, text, lang in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": k is not None and any(j is not None and j < k and (t or "") == text for j, t, _ in docs),
        }
        rows.append((lang or "", {c for c in "ABCDE" if fails[c]}, k in good, k in toxic))
    out, shares = [], {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone, left = [r for r in left if c in r[1]], [r for r in left if c not in r[1]]
                shares[part, c] = shares.get((part, c), 0) + len(gone)
                out.append((part, "".join(order), step, c, len(left), len(gone), sum(c in r[1] for r in own) - len(gone), sum(r[1] == {c} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)))
    return sorted((*r[:3], *r[4:], shares[r[0], r[3]]) for r in out)


def audited(spark, docs, labels):
    df = spark.createDataFrame([(k, t, lang, "x", "y") for k, t, lang in docs], "doc_id long, text string, lang string, mask string, digest string")
    marks = spark.createDataFrame([(*x, "z") for x in labels], "doc_id long, quality int, toxic int, good string")
    return sorted(tuple(r) for r in filter_audit.audit(df, marks).collect())


def test_audit_equals_running_every_order(spark):
    rng = random.Random(4)
    docs = []
    for i in range(150):
        words = [rng.choice(["aa", "Bb", "cé", f"w{rng.randrange(500)}", f"w{rng.randrange(500)}"]) for _ in range(rng.choice([5, 199, 200, 260]))]
        text = rng.choice([" ", "\n", "\x0b"]).join(words) + rng.choice(["", "", " #", " 5 %"])
        docs.append((i, docs[rng.randrange(i)][1] if i and rng.random() < 0.3 else text, rng.choice(["de", "en", None, ""])))
    labels = [(rng.randrange(170), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)


def test_audit_of_odd_rows(spark):
    long = " ".join(f"w{i % 30000}" for i in range(70_000))
    docs = [(1, None, None), (2, "", "en"), (2, "", "en"), (None, "", "en"), (3, long, "en"), (3, long, "en"), (4, long, "fr"), (5, "   ", "fr"), (-1, long + " ", "fr"), (6, "|", None)]
    labels = [(2, 1, 0), (2, 1, 1), (None, 1, 1), (4, 0, 1)]
    assert audited(spark, docs, labels) == brute_audit(docs, labels)
    assert audited(spark, [], labels) == []
    assert audited(spark, docs, []) == brute_audit(docs, [])


def test_polynomials_against_their_definition():
    rng = random.Random(1)
    counts = {m: rng.randrange(10**15) for m in range(32)}
    f = filter_audit.removal_polynomial(counts, 5)
    assert filter_audit.corners(f) == [sum(c for m, c in counts.items() if m & s) for s in range(32)]
    shares = [filter_audit.shapley(f, k) for k in range(5)]
    assert sum(shares) == sum(c for m, c in counts.items() if m)
    for k in range(5):
        added = sum(sum(c for m, c in counts.items() if m >> k & 1 and not any(m >> j & 1 for j in order[: order.index(k)])) for order in permutations(range(5)))
        assert 120 * shares[k] == added


# Prefix trie


def brute_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [t[1:] for t in sorted(x)] for c, x in turns.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        made[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        saved[p] = own + sum(saved[k] for k in kids.get(p, []))
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], digest(ends.get(p, []))) for p, m in members.items()), key=repr)


def grown(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, depth string, pos string")
    return sorted((tuple(r) for r in prefix_trie.trie(df, **more).collect()), key=repr)


def chats(rng, n):
    rows, seen = [], []
    for c in rng.sample(range(-20, 4 * n), n):
        if seen and rng.random() < 0.6:
            old = rng.choice(seen)
            turns = old[: rng.randrange(len(old) + 1)] if rng.random() < 0.7 else list(old)
        else:
            turns = []
        turns = turns + [(rng.choice(["user", "assistant", None]), f"té{rng.randrange(6)}") for _ in range(rng.randrange(12))]
        seen.append(turns)
        rows += [(c, i, *t) for i, t in enumerate(turns)]
    rng.shuffle(rows)
    return rows


def test_trie_equals_brute_force(spark):
    rows = chats(random.Random(6), 120)
    assert grown(spark, rows) == brute_trie(rows)


def test_trie_with_colliding_fingerprints(spark):
    rows = chats(random.Random(7), 60)
    assert grown(spark, rows, moduli=(5, 7)) == brute_trie(rows)


def test_trie_of_long_and_equal_conversations(spark):
    rows = [(c, t, "user", f"line {t % 7}") for c in (5, 6, 7, 11) for t in range(700)] + [(100 + 5 * c, 0, "user", "hello") for c in range(300)]
    assert grown(spark, rows) == brute_trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (5, None, None, None), (5, None, "user", "b"), (5, 3, "user", "c"), (5, 3, "user", "c"), (6, 1, "user", ""), (7, 1, "", "user"), (9, 1, "user", "x" * 300_000), (-3, 2, "u", "中文"), (8, 2, "u", "中文")]
    assert grown(spark, rows) == brute_trie(rows)
    assert grown(spark, []) == [] and grown(spark, [(None, 1, "a", "b")]) == []
