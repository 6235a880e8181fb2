"""Quality votes by held-out accuracy and brute force, the filter audit and ball-tree clusters against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from benefold.llm import ball_clusters, filter_audit, quality_votes

# --- 11 -------------------------------------------------------------------------------------------------------------


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijk") for _ in range(r.randrange(2, 7))) for _ in range(n)).capitalize() + "."


def junk(r, n):
    return r.choice([" | ", "!! ", "$$$ "]).join(w.upper() if n % 2 else w for w in prose(r, n).split())


def test_votes_learn_and_hold_out(spark):
    r = random.Random(1)
    docs, labels = [], []
    for i in range(700):
        good = r.random() < 0.7
        docs.append((i, (prose if good else junk)(r, r.randrange(20, 80))))
        labels.append((i, int(good)))
    docs += [(900, None), (901, ""), (902, " \n"), (None, prose(r, 40)), (0, docs[0][1])]
    labels += [(900, None), (None, 0), (0, labels[0][1])]
    d = spark.createDataFrame([(*x, 1, "z") for x in docs], "doc_id long, text string, label int, x string").repartition(4)
    lab = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, _label string")
    space = quality_votes.fit(d, lab)
    out = [(x["id"], x["score"]) for x in quality_votes.score(d, space).collect()]
    assert len(out) == len(docs) and all(0 <= s <= 1 for _, s in out)
    truth = dict(labels)
    held = {i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([(s >= 0.3) == bool(truth[i]) for i, s in out if i in held]) > 0.97 and len(held) > 100
    known = {i: y for i, y in truth.items() if i is not None and i < 700 and i not in held}
    assert abs(space.prior - (sum(known.values()) + (truth[0] if 0 not in held else 0)) / (len(known) + (0 not in held))) < 1e-9
    assert all(s == space.prior for i, s in out if i in (900, 901, 902)) and len({s for i, s in out if i == 0}) == 1
    assert quality_votes.score(d.limit(0), space).count() == 0
    none = quality_votes.fit(d, lab.limit(0))
    assert {x["score"] for x in quality_votes.score(d, none).collect()} == {0.5}
    assert quality_votes.score(d.limit(0), quality_votes.fit(d.limit(0), lab)).count() == 0


def test_vote_against_brute_force():
    r = np.random.default_rng(2)
    axes, voters = r.normal(size=(2 * quality_votes.BUCKETS, 5)).astype(np.float32), quality_votes.unit(r.normal(size=(60, 5)))
    labels = r.integers(0, 2, 60)
    space = quality_votes.Space(np.ones(2 * quality_votes.BUCKETS), axes, voters, labels, np.where(labels == 1, 3.0, 0.5), 0.8)
    x = r.random((700, 2 * quality_votes.BUCKETS)).astype(np.float32)
    x[3] = 0
    got = quality_votes.vote(x, space, 7)
    assert got[3] == 0.8
    for i in (0, 1, 255, 256, 699):
        v = x[i] @ axes
        like = sorted(((float(v @ c) / np.linalg.norm(v), k) for k, c in enumerate(voters)), reverse=True)[:7]
        w = [max(s, 0) * space.weights[k] for s, k in like]
        assert abs(got[i] - sum(a * labels[k] for a, (_, k) in zip(w, like, strict=True)) / sum(w)) < 1e-4


def test_terms_of_texts_don_t_depend_on_their_neighbours():
    import pyarrow as pa

    def one(texts):
        return [sorted(zip(bucket[row == k].tolist(), n[row == k].tolist(), strict=True)) for _, rows, row, bucket, n in quality_votes.counts(pa.array(texts)) for k in range(rows)]

    texts = ["The the THE!!! ab12", None, "", "a", "a", "x y x y\n", "Über façade  漢字", "### ab | cd |"]
    assert one(texts) == [one([t])[0] for t in texts] and one(["x y x y\n"])[0] != one(["x x y y"])[0]
    long = "word other " * 300_000
    got = dict(one(["a", long, "b"])[1])
    short = dict(one([long[:2200]])[0])
    assert set(short) == set(got) and max(got.values()) >= 300_000


# --- 12 -------------------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A"} if len(w) < 200 else set()
        fails |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs) else set()
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {x[0] for x in rows}:
        total = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = [x for x in rows if x[0] == part]
            for k, f in enumerate(order, 1):
                gone, stay = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                all_fails = [x for x in rows if x[0] == part and f in x[1]]
                out[part, "".join(order), k] = [len(stay), len(gone), len(all_fails) - len(gone), sum(x[1] == {f} for x in all_fails), sum(x[2] for x in gone), sum(x[3] for x in gone), f]
                total[f] += len(gone)
                left = stay
        for key in [k for k in out if k[0] == part]:
            out[key][6] = total[out[key][6]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_against_brute_force(spark):
    r = random.Random(3)
    docs = []
    for i in range(150):
        n = r.choice([0, 3, 150, 199, 200, 201, 260])
        words = [r.choice(["aa", "bb", "Cc", "$d", "EEE", f"w{r.randrange(500)}", f"v{r.randrange(500)}"]) for _ in range(n)]
        docs.append((i, r.choice([" ", "\n", "  ", "\x0b"]).join(words), r.choice(["en", "de", None, ""])))
    docs += [(1000 + i, docs[7][1], "fr") for i in range(40)] + [(2, docs[9][1], "en"), (None, docs[7][1], "en"), (None, None, None), (2000, None, "en"), (2001, "", "en"), (7, docs[7][1], "en"), (3000, "x" * 300_000 + " y" * 100_000, "en")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 1100, 3)] * 2 + [(3, 1, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*x, 1, "a", True) for x in docs], "doc_id long, text string, lang string, mask int, part string, good boolean").repartition(3)
    lab = spark.createDataFrame([(*x, 5) for x in labels], "doc_id long, quality int, toxic int, id int")
    got = {(x["part"], x["filter_order"], x["step"]): (x["kept"], x["removed"], x["redundant"], x["unique_fails"], x["good_lost"], x["toxic_lost"], x["shapley"]) for x in filter_audit.audit(filter_audit.cells(filter_audit.masks(d), lab)).collect()}
    want = brute_audit(docs, labels)
    assert got == want and len(got) == 600 * 4
    assert filter_audit.audit(filter_audit.cells(filter_audit.masks(d.limit(0)), lab)).count() == 0
    alone = filter_audit.audit(filter_audit.cells(filter_audit.masks(d), lab.limit(0)))
    assert alone.count() == 2400 and alone.where("good_lost <> 0 OR toxic_lost <> 0").count() == 0


# --- 13 -------------------------------------------------------------------------------------------------------------


def brute_clusters(rows, clusters=16, rounds=3):
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in rows if i is not None)[:clusters]
    centroids = [list(q) for _, q in first]
    nearest = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, q in rows:
            groups.setdefault(nearest(q)[1], []).append(q)
        for k, members in groups.items():
            centroids[k] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *nearest(q)[::-1]) for i, q in rows]
    inertia = {k: sum(d for _, c, d in found if c == k) for k in range(clusters)}
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in found), key=str)


@pytest.mark.parametrize("shape", ["groups", "ties", "large"])
def test_clusters_against_brute_force(spark, shape):
    r = np.random.default_rng(4)
    if shape == "groups":  # tight groups, half of all rows copies of one vector
        middle = r.normal(size=(9, 64))
        v = np.concatenate([middle[r.integers(0, 9, 700)] + r.normal(size=(700, 64)) * 0.02, np.repeat(middle[:1], 700, 0)])
    elif shape == "ties":  # few values, many equal distances
        v = r.integers(0, 2, (900, 64)) * (r.random((900, 1)) < 0.3) / 64.0
    else:  # beyond the range of exact float products
        v = r.uniform(-1, 1, size=(300, 64)) * 2.0**19
    v = v.astype(np.float32)
    rows = [(i, [float(x) for x in q], "q") for i, q in enumerate(v)]
    bad = [(5000, None, ""), (5001, [1.0] * 63, ""), (5002, [1.0] * 65, ""), (5003, [None] + [1.0] * 63, ""), (5004, [float("nan")] * 64, ""), (5005, [float("-inf")] + [0.0] * 63, ""), (5006, [3e30] * 64, "")]
    rows += [(None, rows[3][1], ""), (4, rows[4][1], ""), (4, rows[5][1], "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, q string").repartition(3)
    got = ball_clusters.cluster(ball_clusters.quantized(df))
    kept = [(i, tuple(int(np.floor(64 * x)) for x in q)) for i, q, _ in rows]
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(kept)


def test_clusters_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>"
    assert ball_clusters.cluster(ball_clusters.quantized(spark.createDataFrame([], schema))).count() == 0
    few = [(i, [float(i % 3)] * 64) for i in range(7)]
    got = ball_clusters.cluster(ball_clusters.quantized(spark.createDataFrame(few, schema))).collect()
    assert sorted(map(tuple, got), key=str) == brute_clusters([(i, tuple(int(64 * x) for x in q)) for i, q in few])


def test_ball_trees_cut_their_vectors():
    r = np.random.default_rng(5)
    v = np.concatenate([r.integers(-50, 50, (333, 8)), np.zeros((200, 8), int)])
    order, first, last = ball_clusters.build(v, 16)
    assert sorted(order) == list(range(len(v))) and (first[0], last[0]) == (0, len(v))
    row = ball_clusters._tree(np.arange(len(v)), np.ones(len(v), bool), v)
    tree = ball_clusters.Tree(row, 8)
    centroids = r.integers(-40, 40, (5, 8))
    found = sorted((a, b) for _, a, b, _, _ in tree.filter(centroids))
    assert [a for a, _ in found] == [0, *(b for _, b in found[:-1])] and found[-1][1] == len(v)
    counts, sums, of = ball_clusters._settle(tree, centroids, True)
    want = ((tree.vectors[:, None].astype(int) - centroids) ** 2).sum(2).argmin(1)
    assert (of == want).all() and counts.tolist() == np.bincount(want, minlength=5).tolist() and all((sums[k] == tree.vectors[want == k].sum(0)).all() for k in range(5))
