"""Personal data, vector codes and the Merkle manifest against plain versions, on given tables and awkward rows."""

import hashlib
import json
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from corpusq.llm import merkle, pii, plans, vector_codes
from corpusq.llm.common import ascii_lower, table
from tests.llm import hostile
from tests.llm.hostile import low, order, sha

SF_DIR = "/root/testdata/sf0.001"

# ---- personal data ---------------------------------------------------------------------------------

RULES = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def plain_base(text):
    found = []
    for kind, rule in RULES.items():
        for m in rule.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            holds = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if holds:
                found.append((kind, m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], list(RULES).index(s[0])))


def plain_pii(rows, rounds=3, support=5):
    """All rounds in dictionaries; the readings of a text (windows, patterns) are the operator's own."""
    known, seen, where = {}, {}, {}
    for n, (_, text) in enumerate(rows):
        text = text or ""
        base = plain_base(text)
        for kind, s, e in base:
            known.setdefault(text[s:e], set()).add(kind)
            seen.setdefault(text[s:e], set()).update(pii.patterns(text, s, e))
        for s, e in pii.windows(text, base):
            seen.setdefault(text[s:e], set()).update(pii.patterns(text, s, e))
            where.setdefault(text[s:e], []).append((n, s, e))
    holders = {}
    for value, own in seen.items():
        for p in own:
            holders.setdefault(p, set()).add(value)
    added = {}
    for _ in range(rounds):
        score = {(v, k): 1000 for v, ks in known.items() for k in ks} | {x: s for x, (s, _) in added.items()}
        good = {}
        for p, values in holders.items():
            for kind in RULES:
                held = sum(score.get((v, kind), 0) for v in values)
                share = held / ((len(values) + 1) * 1000)
                if held >= support * 1000 and share >= 0.8:
                    good[p, kind] = math.floor(-math.log(1 - share) * 1_000_000)
        added = {}
        for value, own in seen.items():
            for kind in RULES:
                cost = sum(good.get((p, kind), 0) for p in own)
                sure = math.floor((1 - math.exp(-cost / 1_000_000)) * 1000)
                if cost and sure >= 900 and kind not in pii.barred(value) and value not in known:
                    added[value, kind] = (sure, cost)
    out = []
    for n, (i, text) in enumerate(rows):
        base = plain_base(text)
        extra = [(-c, s - e, s, list(RULES).index(k), k, e) for (v, k), (_, c) in added.items() for m, s, e in where.get(v, ()) if m == n]
        chosen = []
        for _, _, s, _, k, e in sorted(extra):
            if all(e <= s2 or e2 <= s for _, s2, e2 in chosen):
                chosen.append((k, s, e))
        out.append((i, tuple(base), tuple(sorted(base + chosen, key=lambda x: (x[1], list(RULES).index(x[0]))))))
    return out


def found_in(df):
    return [(r[0], tuple(map(tuple, r.base)), tuple(map(tuple, r.spans))) for r in df.collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (order(r[0]), r[1:]))


def identifiers(n=40):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        rows.append((1000 + i, f"text {rng.random()} call {phone} today. Write to u{i}@mail{i % 3}.example.com or {i}.2.3.4"))
    # The rules miss both: the phone runs into the number after it; the mail has no dot in its host.
    rows.append((2000, "the line +1 (777) 555-1234 190.1.2.3 rings"))
    rows.append((2001, "Write to someone.7@mailhost or not"))
    rows.append((2002, "a clean text of 2024-01-15 with 12345678 and 300.400.500.600 and 4111111111111112"))
    return rows


def test_rules_equal_the_plain_expressions():
    rng = random.Random(1)
    parts = ["a", "@", ".", "-", "_", "+", "1", "22", "4111111111111111", " ", "(", ")", "é", "b.c", "\n", "٣", "=", ":"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(30)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_texts_take_linear_time():
    for text in ("x" * 300_000, "9" * 300_000, "a@" * 150_000, "+" + "(" * 300_000, "1.1." * 80_000, "9 " * 100_000):
        assert pii.base_spans(text) is not None
        assert sum(1 for _ in pii.windows(text, [])) >= 0


def test_bootstrapping_equals_a_plain_version_and_finds_unseen_identifiers(spark):
    rows = identifiers() + hostile.texts()
    got = found_in(pii.find_pii(hostile.documents(spark, rows)))
    assert by_id(got) == by_id(plain_pii(rows))
    added = {i: set(spans) - set(base) for i, base, spans in got if i and 2000 <= i < 2003}
    assert added[2000] == {("phone", 9, 26)} and not added[2002]

    docs = table(spark, SF_DIR, "documents")
    given = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert by_id(found_in(pii.find_pii(docs))) == by_id(plain_pii(given))


def test_given_seeds_of_another_kind(spark):
    rows = [(i, f'the token = "k{i}f00dbeef{i * 7919:08d}" was {i}') for i in range(30)]
    seeds = spark.createDataFrame([(f"k{i}f00dbeef{i * 7919:08d}", "secret") for i in range(25)], "value string, kind string")
    got = found_in(pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string"), seeds=seeds))
    assert all([s[0] for s in spans] == ["secret"] for _, _, spans in got)


def test_no_rows_have_no_personal_data(spark):
    assert pii.find_pii(hostile.documents(spark, [])).count() == 0


def test_digest_of_personal_data(spark):
    for r in plans.op11_pii(spark, SF_DIR).collect():
        spans = [s.split(":") for s in r.spans.split(",")] if r.spans else []
        base = r.n_email + r.n_ip + r.n_card + r.n_phone
        assert len(spans) == base + r.n_added
        if not r.n_added:
            assert sha(r.spans) == r.base_sha256


# ---- vector codes ----------------------------------------------------------------------------------


def plain_codes(rows):
    def whole(x):
        return math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256

    def far(a, b):
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))

    kept = [(i, [whole(x) for x in v], c) for i, v, c in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for length in sorted({len(v) for _, v, _ in kept}):
        own = [r for r in kept if len(r[1]) == length]
        cut = [-(-length * p // 16) for p in range(17)]
        first = sorted(own, key=lambda r: (order(r[0]), r[1]))[:64]
        books = [[v[cut[p] : cut[p + 1]] for _, v, _ in first] for p in range(16)]

        def nearest():
            return [
                [min(range(len(books[p])), key=lambda e: (far(v[cut[p] : cut[p + 1]], books[p][e]), e)) for p in range(16)]
                for _, v, _ in own
            ]

        for _ in range(2):
            found = nearest()
            for p in range(16):
                for e in range(len(books[p])):
                    members = [v[cut[p] : cut[p + 1]] for (_, v, _), x in zip(own, found, strict=True) if x[p] == e]
                    if members:
                        books[p][e] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        digest = sha(",".join(str(x) for p in range(16) for e in books[p] for x in e))
        for (i, v, c), x in zip(own, nearest(), strict=True):
            error = sum(far(v[cut[p] : cut[p + 1]], books[p][x[p]]) for p in range(16))
            out.append((i, "".join(f"{e:02x}" for e in x), min(error, 2**63 - 1), c, digest))
    total: dict = {}
    for _, _, error, c, _ in out:
        total[c] = total.get(c, 0) + error
    return sorted(((i, code, e, min(total[c], 2**63 - 1), d) for i, code, e, c, d in out), key=lambda r: (order(r[0]), r[1:]))


def codes_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (order(r[0]), r[1:]))


def test_vector_codes_equal_a_plain_version(spark):
    vectors = table(spark, SF_DIR, "embeddings")
    rows = [tuple(r) for r in vectors.select("vec_id", "embedding", "label").collect()]
    coded, books = vector_codes.compress(vectors, block_rows=100)
    got = codes_of(coded)
    assert got == plain_codes(rows)
    given = {i: [math.floor(256 * x) for x in v] for i, v, _ in rows}
    for i, code, error, *_ in got[:20]:
        back = vector_codes.decode(code, books[64])
        assert sum((a - b) ** 2 for a, b in zip(given[i], back, strict=True)) == error


def test_vector_codes_of_awkward_rows(spark):
    rows = [
        (1, [1.0] * 20, 1), (1, [1.0] * 20, 1), (2, [3e38] + [0.5] * 19, None), (None, [-3e38] + [0.25] * 19, None), (3, [], 2),
        (4, None, 1), (5, [float("nan")] * 20, 1), (6, [None] * 20, 1), (7, [0.1, -0.3], 5), (8, [1e308] * 20, 9), (8, [-1e308] * 20, 9),
    ]
    rows += [(20 + i, [((i * 7 + j * j) % 13) / 7 - 1 for j in range(20)], i % 3) for i in range(100)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for name in ("id", "v", "length", "error", "code", "ids"):
        vectors = vectors.withColumn(name, F.lit("x"))
    assert codes_of(vector_codes.compress(vectors, block_rows=7)[0]) == plain_codes(rows)
    assert vector_codes.compress(vectors.where("false"))[0].count() == 0


# ---- Merkle manifest -------------------------------------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(row):
    return sha("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS))


def plain_tree(nodes, fanout):
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, p in zip(ways, at, strict=True):
            start = p - p % fanout
            way.append(("".join(nodes[start:p]), "".join(nodes[p + 1 : start + fanout])))
        nodes = [sha("".join(nodes[i : i + fanout])) for i in range(0, len(nodes), fanout)]
        at = [p // fanout for p in at]
    return nodes[0], ways


def plain_manifest(rows, fanout=8):
    groups: dict = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    langs = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    parts = []
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        parts.append((own, *plain_tree([leaf(r) for r in own], fanout)))
    root, tops = plain_tree([p[1] for p in parts], fanout) if parts else (None, [])
    out = []
    for (own, subroot, ways), top in zip(parts, tops, strict=True):
        for r, way in zip(own, ways, strict=True):
            later = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                later["text"] = low(r["text"])
            folded = leaf(later)
            for before, after in way + top:
                folded = sha(before + folded + after)
            proof = sha("".join(b + a for b, a in way + top))
            out.append((r["doc_id"], leaf(r), subroot, root, proof, folded, folded == root))
    return sorted(out, key=lambda r: (order(r[0]), r[1:]))


def manifest_of(docs, **args):
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = merkle.manifest(docs, found={"text": text}, **args).select(names).collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (order(r[0]), r[1:]))


def test_manifest_equals_a_plain_version_whatever_the_partitions(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = [r.asDict() for r in docs.collect()]
    assert manifest_of(docs) == plain_manifest(rows)
    # Narrow partitions: many rounds, and subtrees that are not full at the right edge.
    for fanout, levels in ((2, 1), (3, 1), (8, 1)):
        assert manifest_of(docs, fanout=fanout, block_levels=levels) == plain_manifest(rows, fanout)


def test_manifest_of_awkward_rows(spark):
    docs = hostile.documents(spark).withColumns({
        "lang": F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("doc_id") > 50, "ß").otherwise("z"),
        "source": F.when(F.col("doc_id") % 2 == 0, "s:1"), "n_chars": F.col("doc_id") * 3,
        "id": F.lit(1), "leaf": F.lit("x"), "block": F.lit(2), "at": F.lit(3),
    })
    rows = [{f: r[f] for f in FIELDS} for r in docs.collect()]
    assert manifest_of(docs, block_levels=1) == plain_manifest(rows)
    assert manifest_of(docs.where("doc_id = 5")) == plain_manifest([r for r in rows if r["doc_id"] == 5])
    assert manifest_of(docs.where("false")) == []


def test_proofs_lead_to_the_root(spark):
    rows = merkle.manifest(table(spark, SF_DIR, "documents"), with_proof=True, block_levels=1).collect()
    for r in rows:
        assert r.verified and merkle.fold(r.leaf, [tuple(p) for p in r.proof]) == r.root
        assert hashlib.sha256("".join(b + a for b, a in r.proof).encode()).hexdigest() == r.proof_sha256


def test_given_queries_name_their_columns(spark):
    want = {
        "op11_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
        "op12_vector_codes": ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
        "op13_merkle_manifest": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    }
    for name, columns in want.items():
        got = json.loads(plans.QUERIES[name](spark, SF_DIR).schema.json())
        assert [f["name"] for f in got["fields"]][: len(columns)] == columns
