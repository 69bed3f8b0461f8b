import hashlib
import math
import random
import re
from collections import Counter

from trackloom.llm import queries, sanitise

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(2 * int(x), 10)) if k % 2 else int(x) for k, x in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns(sf_rows):
    rnd = random.Random(3)
    bits = ["@", "a", ".", "-", "1", "+", " ", "4111 1111-1111 1111", "10.0.0.1", "256", "x@y.z", "(", "é", "+49 30 1234567", "%", "_", "12345678901234567890", "000.1.02.255"]
    texts = ["".join(rnd.choices(bits, k=rnd.randint(0, 14))) for _ in range(8000)] + [r["text"] for r in sf_rows]
    for t in texts:
        assert [s[:3] for s in sanitise.base_spans(t)] == brute(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 300_000, "a@" * 100_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "+1 " * 100_000):
        sanitise.base_spans(t)


def test_query(spark, sf_rows):
    got = {r["doc_id"]: r for r in queries.op6_disclosure(spark, "/root/testdata/sf0.001").collect()}
    for r in sf_rows:
        want, g = brute(r["text"]), got[r["doc_id"]]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [g[f"n_{k}"] for k in PATTERNS] == [sum(x[0] == k for x in want) for k in PATTERNS]
        assert g["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert g["spans"] == joined or g["spans"].startswith(joined) and all(x.startswith("term:") for x in g["spans"][len(joined) :].strip(",").split(","))


def disclosures(rows):
    """Terms by mutual information, over documents held in memory."""
    n_e, met, ctx, df = Counter(), Counter(), {}, Counter()
    near = []
    for _, t in rows:
        spans = sanitise.base_spans(t or "")
        for e in {f"{k}:{v}" for k, _, _, v in spans}:
            n_e[e] += 1
        df.update(set(re.findall(r"[^\W_]+", (t or "").lower())))
        here = sanitise.near_terms(t, spans, 8) if spans else []
        near.append(here)
        for e, w, c, _ in here:
            met[e, w] += 1
            ctx.setdefault((e, w), set()).add(c)
    told = {}
    for (e, w), n in met.items():
        if n >= 3 and len(ctx[e, w]) > 1 and n_e[e] >= 3 and n_e[e] < len(rows):
            share = math.log(n * len(rows) / (max(df[w], n) * n_e[e])) / math.log(len(rows) / n_e[e])
            if share >= 0.6:
                told[e, w] = "remove" if share >= 0.9 else "generalise"
    return near, told


CORPUS = (
    [(i, f"note {w} write to agent smith at smith@corp.example.com about {w} the plan") for i, w in enumerate(["red", "blue", "green", "grey"])]
    + [(10 + i, f"the {w} plan is about nothing, write to the office at noon") for i, w in enumerate(["one", "two", "three", "four", "five", "six"] * 4)]
    + [(50 + i, "copied text with rare words call +49 30 1234567 zebra quagga") for i in range(5)]
)


def test_terms_that_reveal_an_entity(spark):
    out = {r["doc_id"]: r for r in sanitise.find(spark.createDataFrame(CORPUS, "doc_id long, text string"), with_text=True).collect()}
    near, told = disclosures(CORPUS)
    assert ("email:smith@corp.example.com", "agent") in told
    for (i, text), here in zip(CORPUS, near, strict=True):
        want = Counter((*p, told[e, w]) for e, w, _, places in here for p in places if (e, w) in told)
        assert Counter((s["start"], s["end"], s["action"]) for s in out[i]["spans"] if s["kind"] == "term") == want
    assert not [s for s in out[50]["spans"] if s["kind"] == "term"]  # one context, copied


def test_sanitised_text(spark, odd, none):
    texts = {r["doc_id"]: r["text"] for r in sanitise.sanitised(spark.createDataFrame(CORPUS, "doc_id long, text string"), keep=[]).collect()}
    assert "smith" not in texts[0] and "<EMAIL>" in texts[0] and " red write to " in texts[0]
    assert texts[50] == "copied text with rare words call <PHONE> zebra quagga"
    assert all(texts[i] == t for i, t in CORPUS if 10 <= i < 50)
    out = sanitise.sanitised(odd, keep=["lang", "fp", "rid"])
    assert out.columns == ["doc_id", "text", "lang", "fp", "rid"]
    want = Counter((r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 11)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] != 11) == want
    assert sanitise.sanitised(none, keep=["lang"]).count() == 0


def test_overlapping_spans():
    span = lambda k, s, e, a="replace": {"kind": k, "start": s, "end": e, "action": a}
    assert sanitise.rewrite("0123456789", [span("ip", 2, 5), span("card", 4, 7), span("term", 8, 9, "remove")]) == "01<IP>79"


def test_an_entity_of_one_or_two_documents_has_terms(spark):
    rows = [(i, f"the plan number{i % 20} is about nothing, write to the office at noon") for i in range(400)]
    rows += [(1000, "write to Grzegorz Brzeczyk at brzeczyk@corp.example.com about the plan")]
    rows += [(1001, "the plan of Oyelaran: call +49 30 1234567 at noon"), (1002, "write to Oyelaran or call +49 30 1234567 about nothing")]
    out = {r["doc_id"]: r["text"] for r in sanitise.sanitised(spark.createDataFrame(rows, "doc_id long, text string"), keep=[]).collect()}
    assert "Grzegorz" not in out[1000] and "Brzeczyk" not in out[1000] and " about the plan" in out[1000]
    assert "Oyelaran" not in out[1001] + out[1002] and out[1002].startswith("write to ")
    assert all(out[i] == t for i, t in rows[:400])


def test_near_terms_equal_a_brute_force():
    rnd = random.Random(8)
    bits = ["Li", "Wu", "李", "王伟", "42", "7", "agent", "x", "_", ",", ".", "\t", "\n", " " * 9, "smith@corp.example.com", "10.0.0.1", "+49 30 1234567", "4111 1111 1111 1111", "z" * 700]
    for _ in range(600):
        text = "".join(rnd.choice(bits) + rnd.choice([" ", "  ", "\n", " "]) for _ in range(rnd.randint(1, 60)))
        spans = sanitise.base_spans(text)
        taken = {i for _, s, e, _ in spans for i in range(s, e)}
        words = [m for m in re.finditer(r"[^\W_]+", text) if not taken & set(range(*m.span()))]
        want = {}
        for kind, s, e, value in spans:
            for m in [m for m in words if m.end() <= s][-8:] + [m for m in words if m.start() >= e][:8]:
                want.setdefault((f"{kind}:{value}", m.group().lower()), set()).add(m.span())
        assert {(e, t): set(p) for e, t, _, p in sanitise.near_terms(text, spans, 8)} == want
    name = "Li" + " " * 12 + "smith@corp.example.com"
    assert [t for _, t, _, _ in sanitise.near_terms(name, sanitise.base_spans(name), 8)] == ["li"]
