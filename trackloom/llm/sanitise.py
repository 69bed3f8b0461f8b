"""Personal data: patterns, and terms whose co-occurrence reveals a protected entity.

Base spans are e-mail addresses, IPv4 addresses, card and phone numbers by pattern and
check. Their values are the protected entities. For each entity e and each term t (a run
of letters or digits, lower-cased, of any length) among the nearest ``reach`` on each side, the corpus gives the
pointwise mutual information log(p(t, e) / (p(t) p(e))) over documents, against the
entity's own information -log p(e). The share of it that t gives away decides: at or above
``remove_at`` t is removed, at or above ``generalise_at`` replaced by a general mark,
wherever it stands near e (Sanchez and Batet's C-sanitisation). Meetings whose contexts
are all alike count as one, as copied text tells no more than one copy. Where t and e meet
in fewer than ``least_support`` documents, p(e | t) is drawn towards p(e) as if t stood in
``prior`` more documents, so few meetings disclose less but entities of any number of
documents have their terms.

Document frequencies are counted over all documents, for terms whose checksum falls in a
bucket of some candidate. The bucket table has sixteen bits a candidate, 8 MB at most, and only
saves work: beyond ``MOST_CANDIDATES`` every term is counted.

Nulls: null text is the empty text; null ids are carried. Repeated rows have their spans
each. Empty input gives no rows. Documents without personal data keep their text. Extra
columns named in ``keep`` are carried, others are not read. Offsets are code points, end
exclusive.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, project

KINDS = ("email", "ip", "card", "phone", "term")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match starts inside a run of digits that failed from its start, so only starts are tried.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
#: Candidate terms for which a bucket table is made: 2^22, so 2^26 bits.
MOST_CANDIDATES = 1 << 22


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value), by kind and start."""
    out = []
    at, past = text.find("@"), 0
    while at >= 0:
        start = at
        while start > past and _LOCAL_END.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            past = m.end()
            out.append(("email", start, past, text[start:past].lower()))
        at = text.find("@", max(at + 1, past))
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups()):
                out.append(("ip", m.start(), m.end(), ".".join(g.lstrip("0") or "0" for g in m.groups())))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if 9 <= len(digits) <= 15:
                out.append(("phone", m.start(), m.end(), digits))
    return out


def near_terms(text: str, spans: list[tuple[str, int, int, str]], reach: int) -> list[tuple[str, str, int, list[tuple[int, int]]]]:
    """(entity, term, context hash, places) for the nearest ``reach`` words outside all spans on either side of each span."""
    starts: list[int] = []
    ends: list[int] = []
    for s, e in sorted((s, e) for _, s, e, _ in spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    free = []
    for m in _WORD.finditer(text):
        k = bisect_left(starts, m.end()) - 1
        if k < 0 or ends[k] <= m.start():
            free.append((m.group().lower(), *m.span()))
    begins = [a for _, a, _ in free]
    found: dict[tuple[str, str], tuple[int, list]] = {}
    for kind, start, end, value in spans:
        words = free[max(0, (k := bisect_left(begins, start)) - reach) : k] + free[(k := bisect_left(begins, end)) : k + reach]
        context = zlib.crc32(" ".join(w for w, _, _ in words).encode())
        for w, a, b in words:
            entry = found.setdefault((f"{kind}:{value}", w), (context, []))
            if (a, b) not in entry[1]:
                entry[1].append((a, b))
    return [(e, t, c, places) for (e, t), (c, places) in found.items()]


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_NEAR = pa.struct([("e", pa.string()), ("t", pa.string()), ("ctx", pa.int64()), ("places", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_SCAN = "rid long, base array<struct<kind:string,start:long,end:long>>, entities array<string>, near array<struct<e:string,t:string,ctx:long,places:array<struct<start:long,end:long>>>>"


def find(docs: DataFrame, *, reach: int = 8, least_support: int = 3, prior: float = 2.0, generalise_at: float = 0.6, remove_at: float = 0.9, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; term spans have an ``action``), and what is kept."""
    spark = docs.sparkSession
    keep = keep or []
    carried = {f"k{i}": name for i, name in enumerate(keep)}
    rows = project(docs, doc_id=id_col, text=text_col, **carried)
    rows = rows.withColumn("doc_id", F.col("doc_id").cast("long"))
    outer = [c for c in rows.columns if c != "text" or with_text]
    fields = [f for f in rows.schema.fields if f.name in outer]
    schema = ", ".join([_SCAN, *(f"{f.name} {f.dataType.simpleString()}" for f in fields)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                b = batch.slice(a, 1000)
                base, ents, near = [], [], []
                for text in b.column("text").to_pylist():
                    spans = base_spans(text) if text else []
                    base.append([{"kind": k, "start": s, "end": e} for k, s, e, _ in spans])
                    ents.append(sorted({f"{k}:{v}" for k, _, _, v in spans}))
                    near.append([{"e": e, "t": t, "ctx": c, "places": [{"start": s, "end": z} for s, z in p]} for e, t, c, p in near_terms(text, spans, reach)] if spans else [])
                ids = pa.array(np.arange(rid, rid + b.num_rows))
                rid += b.num_rows
                yield pa.RecordBatch.from_arrays([ids, pa.array(base, pa.list_(_SPAN)), pa.array(ents, pa.list_(pa.string())), pa.array(near, pa.list_(_NEAR)), *(b.column(c) for c in outer)], names=["rid", "base", "entities", "near", *outer])

    scanned = materialise(rows.mapInArrow(scan, schema), "scanned")
    again = lambda: spark.read.schema(scanned.schema).parquet(scanned.trackloom_path)
    total = scanned.count()
    often = scanned.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    met = scanned.select(F.explode("near").alias("x")).select("x.e", "x.t", "x.ctx").groupBy("e", "t").agg(F.count("*").alias("n"), F.min("ctx").alias("c1"), F.max("ctx").alias("c2"))
    met = met.select("e", "t", "n", F.when(F.col("c1") == F.col("c2"), 1).otherwise(F.col("n")).alias("m"))
    pairs = materialise(met.join(often, "e").select("e", "t", "n", "m", "n_e"), "pairs")
    terms = materialise(pairs.select("t").distinct(), "terms")
    n_terms = terms.count()
    buckets = 1 << max(20, (16 * min(n_terms, MOST_CANDIDATES)).bit_length())
    if n_terms <= MOST_CANDIDATES:
        used = terms.select((F.crc32(F.col("t").cast("binary")) % buckets).cast("int").alias("b")).toArrow().column(0).to_numpy()
        table = np.zeros(buckets, bool)
        table[used] = True
    else:
        table = np.ones(buckets, bool)
    table = np.packbits(table, bitorder="little")
    shared = spark.sparkContext.broadcast(table)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = shared.value.tobytes(), Counter()
        known: dict[str, bool] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["t", "df"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for t in set(_WORD.findall((text or "").lower())):
                    hit = known.get(t)
                    if hit is None:
                        if len(known) > 500_000:
                            known.clear()
                        at = zlib.crc32(t.encode()) % buckets
                        hit = known[t] = bool(table[at >> 3] >> (at & 7) & 1)
                    if hit:
                        n[t] += 1
            if len(n) > 1_000_000:
                yield out()
                n.clear()
        yield out()

    if n_terms:
        df = rows.select("text").mapInArrow(frequency, "t string, df long").groupBy("t").agg(F.sum("df").alias("df")).join(terms, "t", "left_semi")
    else:
        df = spark.createDataFrame([], "t string, df long")
    seen = F.greatest(F.coalesce("df", "n"), F.col("n"))
    drawn = F.when(F.col("m") < least_support, F.lit(float(prior))).otherwise(0.0)
    chance = F.col("n_e") / F.lit(float(total))
    given = F.log((F.col("m") + drawn * chance) / (seen + drawn) / chance) / -F.log(chance)
    told = pairs.filter(F.col("n_e") < total).join(df, "t", "left").withColumn("share", given).filter(F.col("share") >= generalise_at)
    told = materialise(told.select("e", "t", F.when(F.col("share") >= remove_at, "remove").otherwise("generalise").alias("action")), "told")
    near = again().select("rid", F.explode("near").alias("x")).select("rid", "x.e", "x.t", "x.places")
    hits = near.join(told, ["e", "t"]).select("rid", "action", F.explode("places").alias("p")).groupBy("rid", "p").agg(F.max("action").alias("action"))
    hits = hits.groupBy(F.col("rid").alias("of")).agg(F.array_sort(F.collect_list(F.struct(F.lit("term").alias("kind"), F.col("p.start").alias("start"), F.col("p.end").alias("end"), "action"))).alias("terms"))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("replace").alias("action")))
    named = [F.col(k).alias(name) for k, name in carried.items()] + ([F.col("text")] if with_text else [])
    bare = scanned.filter(F.size("near") == 0).select("doc_id", "base", plain.alias("spans"), *named)
    some = again().filter(F.size("near") > 0).join(hits, F.col("rid") == F.col("of"), "left")
    return bare.unionByName(some.select("doc_id", "base", F.concat(plain, F.coalesce("terms", F.array().cast(scanned_terms()))).alias("spans"), *named))


def scanned_terms() -> str:
    return "array<struct<kind:string,start:bigint,end:bigint,action:string>>"


def rewrite(text: str, spans: list[dict]) -> str:
    """The text with its spans replaced; spans that overlap become the first one's mark."""
    out, past = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] < past:
            if s["end"] > past:
                past = s["end"]
            continue
        out.append(text[past : s["start"]])
        out.append("" if s["action"] == "remove" else f"<{s['kind'].upper()}>")
        past = s["end"]
    return "".join(out) + text[past:]


def sanitised(docs: DataFrame, *, keep: list[str], id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, text without personal data, and the columns kept."""
    found = find(docs, id_col=id_col, text_col=text_col, keep=keep, with_text=True, **options)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                b = batch.slice(a, 1000)
                texts = [rewrite(t, s) if s else t for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string()), *(b.column(f"c{i}") for i in range(len(keep)))], names=["doc_id", "text", *(f"c{i}" for i in range(len(keep)))])

    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    inner = found.select("doc_id", "text", "spans", *(F.col(f"`{name}`").alias(f"c{i}") for i, name in enumerate(keep)))
    out = inner.mapInArrow(run, ", ".join(["doc_id long", "text string", *(f"c{i} {kinds[name]}" for i, name in enumerate(keep))]))
    return out.select("doc_id", "text", *(F.col(f"c{i}").alias(name) for i, name in enumerate(keep)))
