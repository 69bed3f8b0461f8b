import random
from collections import Counter

import numpy as np
import xxhash

from trackloom.llm import queries, simhash


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 3 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(rows, bits=2):
    fps = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return Counter((doc, f"{fps[i]:016x}", least.get(find(i))) for i, (doc, _) in enumerate(rows))


def test_query_equals_brute_force(spark, sf_rows):
    got = queries.op10_simhash_byte_index(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == brute([(r["doc_id"], r["text"]) for r in sf_rows])


def test_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert simhash.near_duplicates(none).count() == 0


def test_long_document_in_parts():
    rnd = random.Random(2)
    text = " ".join(rnd.choice("abcdefgh") * rnd.randint(1, 3) for _ in range(9000))
    assert int(simhash.fingerprints_of(["x", text, None or ""])[1]) == fingerprint(text)


def near(members, bits):
    return [(a, b) for i, a in enumerate(members) for b in members[:i] if (a ^ b).bit_count() <= bits]


def classes(members, links):
    root = {m: m for m in members}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    for a, b in links:
        root[find(a)] = find(b)
    groups = {}
    for m in members:
        groups.setdefault(find(m), set()).add(m)
    return sorted(map(sorted, groups.values()))


def test_links_within_a_list_span_its_classes():
    rnd = random.Random(4)
    for n, width in ((2, 4), (60, 8), (400, 12), (3000, 14), (6000, 15)):
        members = sorted(rnd.sample(range(1 << width), min(n, 1 << width)))
        signed = np.array([m << 20 | 1 << 63 for m in members], np.uint64).view(np.int64)
        links = [(a >> 20 & 0xFFFFF, b >> 20 & 0xFFFFF) for a, b in simhash.spanning_links(signed, 2)]
        assert all(a in members and b in members for a, b in links) and len(links) < len(members)
        assert classes(members, links) == classes(members, near(members, 2))


def test_index_finds_every_pair(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, 3))) for b in base for _ in range(4)} | {base[0] ^ x for x in range(200)})
    signed = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for bits in (0, 1, 2, 3):
        for most in (4096, 8):  # 8: large blocks are cut by further positions
            got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(signed, bits, most).collect()]
            assert classes(fps, got) == classes(fps, near(fps, bits))


def test_a_tally_never_misses_a_link():
    rng = np.random.default_rng(3)
    members = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    members[1::2] = members[::2] ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64))
    hit = simhash.tallied(members.view(np.uint8).reshape(-1, 8), 6, 2)
    for i in range(0, 300, 7):
        assert hit(np.arange(300), i).tolist() == [(int(a) ^ int(members[i])).bit_count() <= 2 for a in members]


def similarity(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def copies(n, seed):
    """Texts and copies of them in which some words are changed: (group, text)."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 7)))
    out = []
    for g in range(n):
        base = [word() for _ in range(rnd.randint(60, 300))]
        out.append((g, " ".join(base)))
        for _ in range(rnd.choice((0, 1, 2, 5))):
            copy = list(base)
            for i in rnd.sample(range(len(base)), max(1, len(base) // 60)):
                copy[i] = word()
            out.append((g, " ".join(copy)))
    return out


def test_representatives_of_near_copies(spark):
    """Recall over all pairs of similarity 0.8 by brute force, and no unlike text goes."""
    texts = copies(150, 1)
    df = spark.createDataFrame([(i, g, t) for i, (g, t) in enumerate(texts)], "doc_id long, _tl_key int, text string").repartition(5)
    kept = {r["doc_id"] for r in simhash.representatives(df).collect()}
    assert {texts[i][0] for i in kept} == set(range(150))
    pairs = [(i, j) for j in range(len(texts)) for i in range(j) if texts[i][0] == texts[j][0] and similarity(texts[i][1], texts[j][1]) >= 0.8]
    missed = sum(i in kept and j in kept for i, j in pairs)
    assert len(pairs) > 200 and missed <= 0.1 * len(pairs)


def test_one_large_group_and_repeated_rows(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: i % 190], f"x{i}", *base[i % 190 + 1 :]])) for i in range(3000)]
    df = spark.createDataFrame([*rows, (0, rows[0][1]), (0, rows[0][1])], "doc_id long, text string").repartition(9)
    assert [r["doc_id"] for r in simhash.representatives(df).collect()] == [0]


def test_wide_links_equal_brute_force_on_few(spark):
    wide = simhash.Wide(tables=84)
    texts = [t for _, t in copies(40, 2)]
    fp = wide.of(texts)
    df = spark.createDataFrame([(bytes(f),) for f in {bytes(x) for x in fp}], "fp binary")
    got = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in simhash.wide_links(df, wide, most=16, held=50).collect()}
    flat = [int.from_bytes(bytes(f), "big") for f in fp]
    index = {bytes(f): i for i, f in enumerate(fp)}
    # a list's links may go through others of its class, never beyond it
    ok = [(i, j) for j in range(len(flat)) for i in range(j) if (flat[i] ^ flat[j]).bit_count() <= wide.most_bits]
    want = classes(list(range(len(flat))), ok)
    mine = classes(list(range(len(flat))), [tuple(index[x] for x in g) for g in got if len(g) == 2])
    where = {m: k for k, c in enumerate(want) for m in c}
    assert all(len({where[m] for m in c}) == 1 for c in mine) and len(mine) <= 1.05 * len(want)


def test_representatives(spark, odd):
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    got = Counter(r["doc_id"] for r in kept.collect())
    # blank texts are one class; 5 and 6 differ in case only; of the rest each stays
    assert got == Counter([1, 4, 5, 7, 8, 9, 10, 11, None])
