"""Mixing, the prefix trie and the Merkle manifest against brute force: nulls, ties, repeats, empty tables, odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from loomlake.llm import merkle, mixing, trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")
H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()

# -- mixing ---------------------------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, source string, size string, target int"


def some_documents():
    rnd = random.Random(1)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else None if i % 11 == 0 else f"s{i % 7}"
        words = [rnd.choice(["a", "b", "été", "x" * rnd.randrange(1, 9), str(rnd.randrange(999))]) for _ in range(rnd.choice([1, 5, 20, 60, 200]))]
        rows.append((i, " \n".join(words), source, "clash", 1))
    rows += [(901, None, "s1", "clash", 1), (902, "", "void", "clash", 1), (903, " \t ", None, "clash", 1), (904, "w " * 30_000, "hot", "clash", 1)]
    return rows + [(5, rows[5][1], rows[5][2], "clash", 1)] * 2 + [(None, "no id at all", "s2", "clash", 1)] * 2


def water(sizes, cap=3):
    """Targets by giving out the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        unit = (total - sum(cap * sizes[s] for s in full)) / (sum(weight[s] for s in order if s not in full) or 1)
        more = {s for s in order if s not in full and weight[s] * unit > cap * sizes[s]}
        if not more:
            return {s: float(cap * sizes[s]) if s in full else weight[s] * unit for s in order}
        full |= more


def drawn(rows):
    """taken of each row: documents one after another in Pareto order, each if it fits."""
    held = []
    for i, text, source, *_ in rows:
        w = WORD.findall(text or "")
        key = f"{'-' if i is None else i}|{hashlib.md5((text or '').encode()).hexdigest()}"
        u = (int(hashlib.md5(key.encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        held.append((source, len(w), -(-16 * len(set(w)) // len(w)) if w else 1, u))
    sizes = Counter()
    for s, n, *_ in held:
        sizes[s] += n
    goals, out = water(sizes), [0] * len(rows)
    for s in sizes:
        own = [(k, *x[1:]) for k, x in enumerate(held) if x[0] == s]
        mass = defaultdict(int)
        for _, n, merit, _ in own:
            mass[merit] += n
        free, k = sorted(mass, reverse=True), math.inf
        left = goals[s]
        while free:
            k = left / sum(m * mass[m] for m in free) if any(mass[m] for m in free) else math.inf
            if k * free[0] <= 3:
                break
            left -= 3 * mass[free.pop(0)]
            k = math.inf
        e = {m: min(3.0, k * m) for m in mass}
        room = max(0, math.floor(goals[s] + 0.5) - sum(math.floor(e[m]) * mass[m] for m in mass))
        groups = defaultdict(list)
        for i, n, merit, u in own:
            whole, odds = math.floor(e[merit]), e[merit] - math.floor(e[merit])
            out[i] = whole * n
            if n and whole < 3:
                groups[u * (1 - odds) / (u * (1 - odds) + odds * (1 - u)) if odds > 0 else 1 + u].append((i, n))
        for rank in sorted(groups):
            words = sum(n for _, n in groups[rank])
            if words <= room:
                room -= words
                for i, n in groups[rank]:
                    out[i] += n
    return sizes, goals, out


def test_mix(spark, monkeypatch):
    rows = some_documents()
    sizes, goals, taken = drawn(rows)
    monkeypatch.setattr(mixing, "SLACK", 1 << 40)  # fill as far as can be
    monkeypatch.setattr(mixing, "ROUNDS", 40)
    df = spark.createDataFrame(rows, DOCS)
    expected = Counter((r[0], len(WORD.findall(r[1] or "")), sizes[r[2]], round(goals[r[2]], 6), t) for r, t in zip(rows, taken))
    for parts in (1, 5):
        found = mixing.mix_documents(df.repartition(parts)).collect()
        assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in found) == expected
    assert all(r.taken == r.copies * r["size"] <= 3 * r["size"] for r in found)
    got = Counter()
    for r in found:
        got[r.source] += r.taken
    assert all(abs(got[s] - goals[s]) <= 0.05 * goals[s] + 1 for s in sizes if s != "hot")
    assert mixing.mix_documents(df.limit(0)).collect() == []


def test_mix_stops_early_and_keeps_its_ends(spark):
    """With production parameters, what stays open is small; all sources full, and the rows themselves."""
    rows = [(i, "w" + str(i % 50) + " x y z " * (i % 40 + 1), f"s{i % 4}") for i in range(4_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix_documents(df)
    got, goal = Counter(), {}
    for r in mixed.collect():
        got[r.source] += r.taken
        goal[r.source] = r.target
    assert all(abs(got[s] - goal[s]) <= 0.01 * goal[s] for s in goal)
    copies = mixing.repeated(df, mixed)
    assert copies.columns == df.columns and copies.count() == mixed.agg({"copies": "sum"}).first()[0]
    one = mixing.mix_documents(spark.createDataFrame([(1, "a b", "only"), (2, "c", "only")], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.target, r.taken) for r in one) == [(1, 3.0, 2), (2, 3.0, 1)]


def test_mix_probabilities(spark):
    """Over many documents of two merits, the shares drawn are near the expected copies of each."""
    rows = [(i, f"a{i} b c d" if i % 2 else f"a{i} b b b", "m" if i % 5 else "n") for i in range(20_000)]
    found = mixing.mix_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    mean = {(r.source, r.odd): r.m for r in found.selectExpr("source", "doc_id % 2 AS odd", "copies").groupBy("source", "odd").agg({"copies": "mean"}).withColumnRenamed("avg(copies)", "m").collect()}
    goal = {r.source: r.t / r.s for r in found.selectExpr("source", "target AS t", "source_size AS s").distinct().collect()}
    for s in ("m", "n"):  # merits 16 and 8: twice the copies, and together the target, unless the cap cuts
        rich = min(3.0, goal[s] * 4 / 3)
        assert abs(mean[s, 1] - rich) < 0.03 and abs(mean[s, 0] - (2 * goal[s] - rich)) < 0.03


# -- prefix trie ----------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth string, owner int"


def nodes_of(rows):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((t is not None, t or 0), hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    turns = {c: [x[2:] for x in sorted(v, key=lambda y: y[:2])] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:]
    members, below = defaultdict(list), defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            below[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[j] for j in below[k]) or 1
        saved[k] = (len(members[k]) - 1) * (len(WORD.findall(k[-1][1])) if k else 0) + sum(saved[j] for j in below[k])
    ends = lambda k, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(k)).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(below[k]), leaves[k], saved[k], ends(k, m)) for k, m in members.items())


def found_nodes(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r[c] for c in names) for r in trie.prefix_trie(df).collect())


def odd_conversations():
    rnd = random.Random(4)
    rows = []
    for c in [*range(-45, 60), 1000, 1001, 1021]:
        if rnd.random() > 0.2:
            for t in range(rnd.choice([1, 1, 2, 3, 4, 5, 9])):
                rows.append((c, rnd.choice([t, t, t, None, 3]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "a", "a b", "", None, "x y  z", "é 　b"]), "clash", 1))
    rows += [(None, 1, "user", "lost", "clash", 1)] + [(7, 1, "user", "a", "clash", 1)] * 3
    return rows + [(2_000, t, "user", "long " * 400, "clash", 1) for t in range(300)] + [(2_001, t, "user", "long " * 400, "clash", 1) for t in range(280)]


@pytest.mark.parametrize(("batch", "piece"), [(10_000, 4_096), (3, 2)])
def test_trie(spark, monkeypatch, batch, piece):
    monkeypatch.setattr(trie, "BATCH", batch)
    monkeypatch.setattr(trie, "PIECE", piece)
    rows = odd_conversations()
    for parts in (1, 6):
        assert found_nodes(spark.createDataFrame(rows, TURNS).repartition(parts)) == nodes_of(rows)
    assert found_nodes(spark.createDataFrame([], TURNS)) == []


def test_trie_of_copies_and_long_branches(spark, monkeypatch):
    """Very many copies of one conversation, hot nodes met by a shuffle and by a broadcast, chains that leave one another."""
    rows = [(20 * k, t, "user", f"turn {t}", "", 0) for k in range(400) for t in range(3)]
    rows += [(20 * k, t, "user", f"turn {t}" if t < k - 1_000 else f"own {k}", "", 0) for k in range(1_000, 1_040) for t in range(k - 990)]
    expected = nodes_of(rows)
    for hot in (1, 1_000):
        monkeypatch.setattr(trie, "HOT", hot)
        assert found_nodes(spark.createDataFrame(rows, TURNS).repartition(4)) == expected


# -- Merkle manifest ------------------------------------------------------------------------------------------------

FIELDS = "doc_id long, source string, lang string, n_chars long, text string, tree string, i int"


def manifest_of(rows, f=2):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: H(*map(field, r[:5]))

    def tower(level):
        out = [level]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][k : k + f]) for k in range(0, len(out[-1]), f)])
        return out

    def path(levels, k):
        out = []
        for level in levels[:-1]:
            s = k // f * f
            out.append((level[s:k], level[k + 1 : s + f]))
            k //= f
        return out

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    held = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    trees = {x: tower([leaf(r) for r in held[x]]) for x in langs}
    top, out = tower([trees[x][-1][0] for x in langs]), []
    for n, x in enumerate(langs):
        for k, r in enumerate(held[x]):
            way = path(trees[x], k) + path(top, n)
            claim = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                claim[3] += 1
            h = leaf(claim)
            for a, b in way:
                h = H(*a, h, *b)
            out.append((r[0], leaf(r), trees[x][-1][0], top[-1][0], H(*[y for a, b in way for y in (*a, *b)]), h, h == top[-1][0]))
    return Counter(out)


def audited(df, **how):
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(tuple(r[c] for c in names) for r in merkle.manifest(df, tampered=merkle.tampered_digest(), **how).collect())


def odd_rows():
    rnd = random.Random(3)
    rows = [(rnd.randrange(-99, 999), rnd.choice(["s", None]), rnd.choice(["en"] * 9 + ["de", None, "é", "z", "￿", "\U0001f600"]), rnd.choice([None, 0, i]), rnd.choice(["", "text:1", "ü\n" * i, None]), "clash", 1) for i in range(400)]
    return rows + [rows[0]] * 3 + [(None, "s", "en", 2**63 - 1, "t", "clash", 1), (None, "s", "en", 1, "t", "clash", 1), (14, "s", "en", 2**63 - 1, "w " * 100_000, "clash", 1)]


@pytest.mark.parametrize(("fanout", "height"), [(2, 10), (2, 1), (2, 3), (3, 2), (5, 1)])
def test_manifest(spark, fanout, height):
    rows = odd_rows()
    assert audited(spark.createDataFrame(rows, FIELDS).repartition(5), fanout=fanout, height=height) == manifest_of(rows, fanout)


def test_small_manifests(spark):
    df = spark.createDataFrame(odd_rows(), FIELDS)
    assert audited(df.limit(0)) == Counter()
    for n in (1, 2, 3, 5):
        one = [(k, "s", "en", k, "t", "", 0) for k in range(n)]
        assert audited(spark.createDataFrame(one, FIELDS), height=1) == manifest_of(one)
    honest = merkle.manifest(df).collect()
    assert all(r.verified and r.folded_root == r.root for r in honest)


def test_levels_and_folds():
    rnd = random.Random(9)
    for n in range(1, 40):
        for f in (2, 3, 7):
            leaves = [H(str(rnd.random())) for _ in range(n)]
            tower = merkle.levels(merkle.matrix(leaves), f, None)
            for k, h in enumerate(leaves):
                way = [merkle.siblings(level, f)[k // f**j] for j, level in enumerate(tower[:-1])]
                assert merkle.fold(h, way) == tower[-1].tobytes().decode()
                assert n == 1 or merkle.fold(H("x"), way) != tower[-1].tobytes().decode()
    assert len(merkle.levels(merkle.matrix([H("a")]), 2, 4)) == 5
