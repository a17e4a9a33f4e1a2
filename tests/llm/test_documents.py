"""Operators over documents: against plain versions, on the small tables and on awkward rows."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pytest
from compare import differs
from pyspark.sql import functions as F

from ledgerstone.llm import decontaminate, licenses, lm, near_dedup, packing, quality, queries, sharding, substring_dedup, suffix_dedup
from ledgerstone.llm.repeats import NO_ID

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, key int, p string, h double, component string, doc string"


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def awkward():
    """Nulls, blanks, repeats inside a text, near copies, ties, non-ASCII, a long text, periodic texts."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base, passage = say(120).split(), say(60)
    docs = [None, "", "   \n\t ", "one", "one", "two words", "Two  WORDS", passage, say(30) + " " + passage + " " + say(30), passage + " " + passage, "for " * 300, "ab" * 400, say(20_000)]
    for k in range(40):
        w = list(base)
        for _ in range(k // 6):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append(" ".join(w))
    docs += [docs[20], docs[20], say(19), say(20), "é" * 30 + passage[:80]]
    return list(enumerate(docs))


def frame(spark, docs):
    return spark.createDataFrame([(d, t, None if d % 3 == 0 else "en", "s", len(t or ""), "x", 1, "y", 0.5, "z", "w") for d, t in docs], SCHEMA)


def table(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


@pytest.fixture(scope="module", params=["small", "awkward"])
def docs(request, small):
    return small if request.param == "small" else awkward()


def test_near_dedup(spark, docs):
    for k, percent in ((3, 85), (5, 80)):
        want = {d: (n, c) for d, (n, c) in brute.components(docs, k, percent).items()}
        got = near_dedup.link(frame(spark, docs), k, percent).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(docs)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_components(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    path = list(range(60))
    rng.shuffle(path)
    links = [*zip(path, path[1:], strict=False), *((-5, 1000 + i) for i in range(400)), *((rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)), (7_000, 7_000), (NO_ID, 8_000), (8_000, NO_ID)]
    least = {x: x for pair in links for x in pair}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    want = {k: v for k, v in least.items() if k != v}
    spark.createDataFrame(links, "a long, b long").repartition(3).write.parquet(str(tmp_path / "links"))
    table = spark.read.parquet(str(tmp_path / "links"))
    sc, jobs = spark.sparkContext, {}
    for limit in (near_dedup.LOCAL, 500, 0):  # in one task, some steps first, steps alone
        monkeypatch.setattr(near_dedup, "LOCAL", limit)
        sc.setJobGroup(f"components {limit}", "")
        got = [(r["key"], r["component"]) for r in near_dedup.components(table).collect()]
        sc.setLocalProperty("spark.jobGroup.id", None)
        jobs[limit] = len(sc.statusTracker().getJobIdsForGroup(f"components {limit}"))
        assert dict(got) == want and len(got) == len(want), limit
    assert min(jobs, key=jobs.get) == max(jobs) and jobs[max(jobs)] <= 4, jobs  # plans stay in the driver: few links, few jobs
    assert not near_dedup.components(table.limit(0)).count()


def test_substring_dedup(spark, docs):
    got = substring_dedup.dedup(frame(spark, docs)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.word_dedup(docs))


def test_suffix_dedup(spark, docs):
    got = suffix_dedup.dedup(frame(spark, docs)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.byte_dedup(docs))


def test_lm(spark, docs):
    got = {r["doc_id"]: tuple(r)[1:] for r in lm.score(frame(spark, docs)).collect()}
    fit = lambda contexts, kinds: lm.strength(lm.kinds(np.array(contexts)), kinds)
    want, *_ = brute.lm(docs, fit=fit)
    assert set(got) == set(want)
    for d, row in want.items():
        assert got[d][:4] == row[:4]
        assert got[d][4:] == pytest.approx(row[4:], abs=1e-9 * row[1] + 1e-8)
    rng = random.Random(4)
    for a in (0.3, 4.0, 60.0, 900.0):  # against the exact solution
        counts = [min(10_000, int(rng.paretovariate(0.8))) for _ in range(500)]
        kinds = round(sum(sum(a / (i + a) for i in range(c)) for c in counts))
        assert fit(counts, kinds) == pytest.approx(brute.strength(counts, kinds), rel=0.12)


def test_lm_automaton(spark, small, monkeypatch):
    """Scores token by token, with given strengths, in short pieces; arcs and failure of a state share the mass 1."""
    monkeypatch.setattr(lm, "strength", lambda expected, counted: 3.5)
    monkeypatch.setattr(lm, "PIECE", 7)
    docs = small[:80]
    want, a2, a3, arcs, fail, p1, one = brute.lm(docs, 3.5, 3.5)
    below = lambda h, w: p1(w) if not h else arcs[h][w] if w in arcs[h] else fail[h] * below(h[1:], w)
    for h in [(), ("<s>",), *[k for k in arcs if len(k) == 2][:20]]:
        assert sum(below(h, w) for w in one) + below(h, "unknown") == pytest.approx(1.0)

    import pyarrow as pa

    table = pa.table([pa.array([0] * len(docs), pa.int32()), pa.array([d for d, _ in docs], pa.int64()), pa.array([t for _, t in docs])], ["bucket", "doc_id", "text"])
    g = lm.Grams(table)
    x1, x2 = g.two(3)
    c1, c2 = (np.append(x.seen, 0) for x in (x1, x2))
    x3 = g.three(3, x2, c2)
    log = lm.traverse(g, x1, x2, x3, c1, c2, np.append(x3.seen, 0), int(c1.sum()), int((c1 > 0).sum()), 3.5, 3.5)
    assert np.add.reduceat(log, g.first) == pytest.approx([want[d][5] for d, _ in docs], abs=1e-8)


def test_sharding(spark, docs):
    rows = sharding.assign(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    text = dict(docs)
    tree = sharding.topology()

    def walk(d, tree):
        path = []
        for level in range(3):
            kids = {}
            for region, rack, shard, w in tree:
                full = [region, rack, str(shard)]
                if full[:level] == path:
                    name = "/".join(full[: level + 1])
                    kids[name] = kids.get(name, 0) + w
            draw = {n: -np.log((int(hashlib.sha256(f"{d}|{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / w for n, w in kids.items()}
            path = min(draw, key=lambda n: (draw[n], n)).split("/")
        return int(path[-1])

    for r in rows:
        b = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 1, zlib.crc32(b), "key")
        assert r["shard"] == walk(r["doc_id"], tree) and r["grown_shard"] == walk(r["doc_id"], sharding.grow(tree))
        assert r["grown_shard"] in (r["shard"], 16)
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_sharding_matches_sql(spark, sf_dir):
    assert differs(spark, "op6_sharding", queries.QUERIES["op6_sharding"], queries.ORACLE_SQL["op6_sharding"], sf_dir) is None


def test_sharding_confines_movement(spark):
    """A shard of more weight takes rows; nothing moves between subtrees whose weights stay."""
    tree = sharding.topology()
    heavier = [(g, r, s, 3.0 if s == 5 else w) for g, r, s, w in tree]
    at = {s: (g, r) for g, r, s, _ in tree}
    rows = spark.range(20_000).select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), heavier).alias("b")).where("a <> b").collect()
    assert rows
    for r in rows:
        (ga, ra), (gb, rb) = at[r["a"]], at[r["b"]]
        assert gb == at[5][0] if ga != gb else (ra == rb and r["b"] == 5) or rb == at[5][1]


def test_packing(spark, docs):
    path = queries.tokenizer_path()
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    rows = packing.pack(frame(spark, docs), path).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for d, t in docs:
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        got = sorted(by_doc[d], key=lambda r: r["piece"])
        assert [r["start"] for r in got] == np.cumsum([0, *[r["length"] for r in got]])[:-1].tolist() and sum(r["length"] for r in got) == len(ids)
        assert all(r["length"] == 1024 for r in got[1:])
        assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in got)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r["length"] for r in rows)
    assert len(bins) <= 1.02 * -(-total // 1024) + 1


def test_both_encoders_agree():
    """Every character below U+0250, in several neighbourhoods."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    plain = Tokenizer.from_file(path)
    texts = [f"{a}{chr(c)}{b}" for c in range(0x250) for a, b in (("", ""), (" a", "b "), ("1 ", " 2"), ("\n", "'s"))] + ["a <|endoftext|> b", "x" * 5000, " \n\t " * 50]
    for text, ids in zip(texts, packing.encode(texts, path), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids


def test_local_search_empties_bins():
    """Best fit leaves four bins of the first lengths; exchanges find the three that suffice."""
    lengths = {44: 2, 27: 2, 26: 1, 23: 2, 22: 2, 21: 1, 20: 1}
    bins = packing.plan(lengths, 100)
    assert sum(bins.values()) <= -(-sum(k * n for k, n in lengths.items()) // 100) + 1
    got = {}
    for pattern, times in bins.items():
        assert sum(pattern) <= 100
        for x in pattern:
            got[x] = got.get(x, 0) + times
    assert got == lengths
    assert packing.plan({}, 100) == {}


def test_local_search_takes_equal_bins_at_once():
    """Of best fit's 110,000 bins more than 4,000 can go; one at a time is no way to get there."""
    lengths = {513: 60_000, 258: 60_000, 257: 60_000, 254: 120_000}
    bins = packing.plan(lengths, 1024)
    assert sum(bins.values()) <= 105_000
    got = {x: sum(p.count(x) * n for p, n in bins.items()) for x in lengths}
    assert got == lengths and max(map(sum, bins)) <= 1024


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT"]
    docs = [(1, None), (2, ""), (3, f"code é\n// {mit}.\nmore"), (4, f"Released under the nice MIT License. {mit} {mit}"), (5, "Licensed under CC BY-NC 4.0."), (6, "licensed but not under anything"), (3, mit)]
    rows = licenses.scan(frame(spark, docs)).collect()
    text = {}
    for d, t in docs:
        text.setdefault(d, []).append(t)
    seen = sorted((r["doc_id"], r["template"]) for r in rows)
    assert seen == [(3, "MIT"), (3, "MIT"), (4, "MIT"), (4, "MIT"), (4, "MIT"), (5, "CC-BY-NC-4.0")]
    for r in rows:
        spans = [t.encode()[r["start_byte"] : r["end_byte"]].decode(errors="replace") for t in text[r["doc_id"]]]
        assert any(x.startswith(("Released", "Licensed")) and x.endswith(("License", "4.0")) for x in spans)
    assert licenses.scan(frame(spark, docs), {}).count() == 0


def test_license_families_are_told_apart(spark):
    """Words and versions that make another license of it; each probe is one license or none."""
    work = "This work is licensed under the GNU {} version {}"
    probes = {
        "Licensed under CC BY-ND 4.0": "CC-BY-ND-4.0", "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "Licensed under CC BY 3.0": "CC-BY-3.0", "Licensed under CC BY-SA 4.0": "CC-BY-SA-4.0",
        work.format("Lesser General Public License,", "3"): "LGPL-3.0", work.format("Affero General Public License,", "3"): "AGPL-3.0", work.format("General Public License,", "2"): "GPL-2.0", work.format("General Public License,", "3"): "GPL-3.0",
        work.format("General Public License,", "4"): None, "Licensed under CC BY 2.0": None, "Licensed under CC BY 4.0.1": None, "Licensed under the Apache License, Version 3.0": None, "Licensed under CC BY-NC-XX 4.0": None,
        licenses.TEMPLATES["BSD-3-Clause-text"]: "BSD-3-Clause-text", licenses.TEMPLATES["BSD-2-Clause-text"]: "BSD-2-Clause-text", licenses.TEMPLATES["MIT-text"] + " " + "filler " * 30: "MIT-text",
    }
    got = {r["doc_id"]: r["template"] for r in licenses.scan(table(spark, list(enumerate(probes)))).collect()}
    assert got == {i: name for i, name in enumerate(probes.values()) if name}


def test_licenses_against_full_alignment(spark):
    """Places found by fingerprints and bands, against an alignment of every template with the whole text."""
    rng = random.Random(8)
    names = sorted(n for n, t in licenses.TEMPLATES.items() if len(t.split()) < 45)
    docs = []
    for k in range(60):
        name = rng.choice(names)
        w = licenses.TEMPLATES[name].split()
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.choice([0, 1])] = [rng.choice(["odd", "words", "here", "nc", "sa"])] * rng.choice([0, 1])
        docs.append((k, " ".join(["some", "text"] * rng.randrange(4) + w + ["and", "more"] * rng.randrange(4))))
    index = licenses.Index(licenses.TEMPLATES)

    def tokens(text):
        buf = np.frombuffer(text.encode(), np.uint8)
        h, start, end, _ = licenses._tokens(buf, np.array([0, len(buf)]))
        return h.tolist(), index.tells(h, buf, start, end)

    def longest(a, b):
        """(matched, first, last + 1) of the longest common subsequence, by the whole table."""
        row, best = [(0, -1)] * (len(b) + 1), (0, 0, 0)
        for x in a:
            new = [row[0]]
            for j, y in enumerate(b):
                here = max(row[j + 1], new[j])
                if x == y:
                    found = (row[j][0] + 1, row[j][1] if row[j][0] else j)
                    here = max(here, found)
                    best = max(best, (*found, j + 1), key=lambda v: (v[0], v[1] - v[2], -v[2]))
                new.append(here)
            row = new
        return best

    want = {}
    for d, text in docs:
        h, tells = tokens(text)
        found = []
        for t, words in enumerate(index.words):
            n, x, y = longest(words.tolist(), h)
            same = sorted(v for v, z in zip(h[x:y], tells[x:y], strict=True) if z) == sorted(index.telling[t].tolist())
            if n >= 3 and n >= 0.8 * (len(words) + y - x - n) and same:
                found.append((-n, y - x, len(words), x, t))
        if found:
            want[d] = index.names[min(found)[-1]]
    best = {}
    for r in licenses.scan(table(spark, docs)).collect():
        best.setdefault(r["doc_id"], []).append((-r["matched_words"], r["template"]))
    assert {d: min(v)[1] for d, v in best.items()} == want and len(want) > 30


def test_decontamination(spark, sf_dir):
    q = "So Anna has 12 apples and Bob has 7 apples, so how many apples do they have in 3 days if each eats 250 g"
    docs = [(1, "intro text. " + q + " and more"), (2, q.replace("Anna", "Mia").replace("Bob", "Tom").replace("12", "31").replace("250 g", "2,5 kg")), (3, q.replace("Bob", "Anna")), (4, None), (5, ""), (6, "nothing of the kind is in this text at all, really nothing"), (None, q), (1, "intro text. " + q + " and more")]
    bench = spark.createDataFrame([(7, q), (8, None), (9, "too short"), (None, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, h int"), bench).collect()}
    assert {(1, 7), (2, 7), (None, 7)} <= got and not {d for d, _ in got} & {4, 5, 6}
    part = {r["doc_id"]: r["coverage"] for r in decontaminate.contamination(table(spark, docs), bench).collect()}
    assert part[3] < part[2] == 1.0  # slots that were two names are one: those windows are inconsistent
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b).collect()}
    assert found >= {(x["doc_id"], y["item_id"]) for x in d.collect() for y in b.collect() if y["text"] in x["text"]}


def test_decontamination_of_sentence_openers_and_short_items(spark):
    q = "Tom has 5 apples. Tom buys 3 more. Tom eats 2 of them. How many apples are left?"
    docs = [(1, "Intro. " + q.replace("Tom", "Alice")), (2, q.replace("Tom buys", "Ann buys")), (3, "he asked What is 7 plus 7 and left"), (4, "What is 7 plus 8?"), (5, "I saw Paris and Rome"), (6, "I saw Rome")]
    bench = table(spark, [(1, q), (2, "What is 2 plus 2?"), (3, "Paris"), (4, " . ")]).withColumnRenamed("doc_id", "item_id")
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.contamination(table(spark, docs), bench).collect()}
    assert got.pop((2, 1)) < 1.0  # two names in place of one: windows with both are inconsistent
    assert got == {(1, 1): 1.0, (3, 2): 1.0, (5, 3): 1.0}


def test_decontamination_of_swapped_names_lists_and_units(spark):
    q = "Anna pays 3 dollars. Bob pays 4 dollars. Carl pays 5 dollars. Dora pays 6 dollars. How much do they pay together?"
    swapped = q
    for a, b in (("Anna", "Mia"), ("Bob", "Tom"), ("Carl", "Zoe"), ("Dora", "Max"), ("3", "13"), ("4", "25"), ("5", "7"), ("6", "9")):
        swapped = swapped.replace(a, b)
    numbers, others = (" ".join(str(x) for x in range(a, a + 18 * b, b)) for a, b in ((1, 1), (31, 7)))
    flour = "He weighs {} of flour and adds {} of sugar into the big bowl slowly"
    pets = "So Ann has 3 cats and {} has 4 dogs so how many pets has Ann in all now Ann wonders"
    docs = [(1, "Intro. " + swapped), (2, "list " + others), (3, "list " + numbers + " end"), (4, flour.format("250 g", "3 kg")), (5, pets.format("Ann")), (6, pets.format("Bea").replace("Ann in", "Sue in"))]
    bench = [(1, q), (2, numbers), (3, flour.format("250g", "3kg")), (4, pets.format("Bea"))]
    got = {(r["doc_id"], r["item_id"]): r["coverage"] for r in decontaminate.contamination(table(spark, docs), table(spark, bench).withColumnRenamed("doc_id", "item_id")).collect()}
    assert (got.pop((1, 1)), got.pop((3, 2)), got.pop((4, 3))) == (1.0, 1.0, 1.0)
    # one name for two: of 14 windows the 7 with the second name go; a name that changes on the way: the 6 with it go
    assert got == {(5, 4): 7 / 14, (6, 4): 8 / 14}
    long = "no end of words " * 30_000 + swapped
    assert decontaminate.contaminated(table(spark, [(1, long)]), table(spark, bench).withColumnRenamed("doc_id", "item_id")).count() == 1


def plain_cotraining(docs, labels):
    """Scores by co-training over one list of documents, no table."""
    import pyarrow as pa
    import xxhash

    rows = sorted(docs, key=lambda r: r["doc_id"])
    batch = pa.RecordBatch.from_pylist([r.asDict() for r in rows], pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())]))
    text, meta = [[] for _ in rows], []
    for a, _, row, col, m in quality.features(batch):
        for r, c in zip(row.tolist(), col.tolist(), strict=True):
            text[a + r].append(c)
        meta += m.tolist()
    ids = [r["doc_id"] for r in rows]
    good = {r["doc_id"]: int(r["quality"] == 1 and r["toxic"] == 0) for r in labels}
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}
    views = [(text, quality.TEXT_BITS, quality.APART), (meta, quality.META_BITS, 0.0)]
    flat = lambda feats, at: (np.repeat(np.arange(len(at)), [len(feats[i]) for i in at]), np.array([c for i in at for c in feats[i]], np.int64))
    given, logit = [{}, {}], [None, None]
    for round_ in range(quality.ROUNDS + 1):
        for k, (feats, bits, apart) in enumerate(views):
            at = [n for n, i in enumerate(ids) if (i in good and not fold[i]) or i in given[k]]
            y = np.array([good[ids[n]] if ids[n] in good else given[k][ids[n]] for n in at], float)
            model = quality.Model(bits).fit(*flat(feats, at), y, quality._balance(y), apart)
            logit[k] = model.logits(*flat(feats, range(len(ids))), len(ids))
        if round_ == quality.ROUNDS:
            break
        sure = []
        for k in (0, 1):
            pick = {}
            for value in (1, 0):
                p = quality._probability(logit[k])
                each = [(float(p[n] if value else 1 - p[n]), np.int64(np.uint64(xxhash.xxh64(int(i).to_bytes(8, "little"), 42).intdigest()).view(np.int64)), i) for n, i in enumerate(ids) if i not in good]
                pick |= {i: value for i in quality.surest(each, quality.picks(len(each)))}
            sure.append(pick)
        given = [{**given[0], **sure[1]}, {**given[1], **sure[0]}]
    test = [n for n, i in enumerate(ids) if i in good and fold[i]]
    y = np.array([good[ids[n]] for n in test], float)
    each = [quality._platt(x[test][:, None], y) for x in logit]
    z = [x * c[0] + c[1] for x, c in zip(logit, each, strict=True)]
    both = quality._platt(np.column_stack([x[test] for x in z]), y)
    return dict(zip(ids, quality._probability(both[0] * z[0] + both[1] * z[1] + both[2]), strict=True))


def test_quality_against_plain_cotraining(spark, sf_dir):
    d, l = (spark.read.parquet(f"{sf_dir}/../sf0.01/{t}.parquet") for t in ("documents", "labels"))
    want = plain_cotraining(d.select("doc_id", "text", "lang", "source").collect(), l.collect())
    got = {r["doc_id"]: r["score"] for r in quality.score(d, l).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_quality_fit_holds_no_copies():
    """Pieces of rows give the model of flat arrays, in a small part of their memory."""
    import tracemalloc

    rng = np.random.default_rng(3)
    counts = [rng.integers(0, 9000, n) for n in (1200, 300)]
    text = [(c, (rng.integers(0, 1 << 20, int(c.sum())) // rng.integers(1, 5000, int(c.sum()))).astype(np.int32)) for c in counts]
    good = {i: int(rng.random() < 0.6) for i in range(0, 1200, 2)}
    meta = [rng.integers(0, 1 << 12, (len(c), 8)) for c in counts]
    views = quality.Views(text[0], meta[0], list(range(1200)), good)
    views.more(text[1], meta[1], list(range(1200, 1500)))
    views.exchange([{1: 1, 1203: 0}, {5: 0, 1400: 1}])
    tracemalloc.start()
    views.fit()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * sum(len(c) for _, c in text) + 16e6, peak  # less than one more copy, and a table of the weights twice
    row, col = np.repeat(np.arange(1500), np.concatenate(counts)), np.concatenate([c for _, c in text])
    for k, (r, c, apart) in enumerate(((row, col, quality.APART), (np.repeat(np.arange(1500), 8), np.concatenate(meta).reshape(-1), 0.0))):
        label = np.array([views.given[k].get(i, -1) if i not in good else good[i] for i in range(1500)])
        rows = np.flatnonzero((label >= 0) & ~quality.held_rows(views.label(), views.ids)[0])
        new = np.full(1500, -1)
        new[rows] = np.arange(len(rows))
        y, kept = label[rows].astype(float), new[r] >= 0
        plain = quality.Model((quality.TEXT_BITS, quality.META_BITS)[k]).fit(new[r][kept], c[kept], y, quality._balance(y), apart)
        assert (plain.w == views.models[k].w).all() and plain.w.any() and plain.bias == views.models[k].bias


def test_quality_of_awkward_tables(spark, sf_dir):
    l = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    assert quality.score(frame(spark, []), l).count() == 0
    assert quality.keep(frame(spark, []), l).count() == 0
    docs = [(None, "no id"), (None, None), (1, "good words " * 50), (1, "good words " * 50), (2, "!!! ### " * 50), (3, "long " * 200_000), (4, "")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 1), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(table(spark, docs).selectExpr("*", "null as lang", "'s' as source", "1 as p0", "'x' as h"), labels).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) if r["doc_id"] is not None else (True, 0) for r in got) == [(False, 1), (False, 1), (False, 2), (False, 3), (False, 4), (True, 0), (True, 0)]
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[1] > scores[2]
    label, ids = np.array([1, 1, 0, -1]), [10, 11, 12, 13]
    held, used = quality.held_rows(label, ids)
    assert held[:2].sum() == 1 and (held[:2] != used[:2]).all() and held[2] and used[2] and not held[3] and not used[3]


def test_quality(spark, sf_dir):
    d, l = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    truth = {r["doc_id"]: r["quality"] == 1 and r["toxic"] == 0 for r in l.collect()}
    held = {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    got = {r["doc_id"]: r["kept"] for r in quality.score(d, l).collect()}
    assert len(got) == d.count()
    good, bad = [i for i in held if truth[i]], [i for i in held if not truth[i]]
    assert np.mean([got[i] for i in good]) > 0.95 and np.mean([not got[i] for i in bad]) > 0.8
    none = quality.score(frame(spark, awkward()), l.limit(0)).collect()
    assert len(none) == len(awkward()) and all(r["kept"] and r["score"] == 0.5 for r in none)
    some = quality.score(frame(spark, awkward()), l).collect()
    assert len(some) == len(awkward())


def test_empty_tables_and_odd_ids(spark):
    empty = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    path = queries.tokenizer_path()
    ops = [near_dedup.link, substring_dedup.dedup, suffix_dedup.dedup, lm.score, sharding.assign, licenses.scan, lambda t: packing.pack(t, path), lambda t: quality.score(t, labels), lambda t: decontaminate.contaminated(t, bench)]
    for op in ops:
        assert op(empty).count() == 0
    text = " ".join(f"w{i}" for i in range(40))
    odd = table(spark, [(None, text), (None, text), (3, text), (3, text), (3, "other " + text)])
    for op in ops[:5]:
        assert op(odd).count() == 5
    gone = {(r["doc_id"], r["n_removed"]) for r in substring_dedup.dedup(odd).collect()}
    assert gone == {(None, 0), (3, 40)}
    assert {(r["doc_id"], r["n_removed"] > 0) for r in suffix_dedup.dedup(odd).collect()} == {(None, False), (3, True)}
    assert {r["component_id"] for r in near_dedup.link(odd).collect()} == {None}
