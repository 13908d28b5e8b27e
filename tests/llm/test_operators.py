"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from tidemark.llm import decontaminate, langid, lines, logbilinear, mixing, secrets, simhash, toolcalls, toxicity, vafile

WORDS = ["".join(chr(97 + int(c)) for c in str(1000 + 7 * i)) for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def text(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "clash") for i, t in rows], DOCS)


def fingerprint(t, width=4):
    low = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark):
    base = text(1, 3000)
    rows = [(5, base), (3, base + " tail"), (9, base.upper()), (2, "one two"), (1, None), (8, ""), (7, text(2, 50)), (4, "ÄÖ x"), (5, base), (None, text(3, 20))]
    got = simhash.groups(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = {i: fingerprint(t) for i, t in rows if i is not None}
    part = {i: {i} for i in fps}
    for _ in fps:
        for i in fps:
            for j in fps:
                if (fps[i] ^ fps[j]).bit_count() <= 4:
                    part[i] |= part[j]
    for r in got:
        if r["id"] is not None:
            assert r["fp"] & (2**64 - 1) == fps[r["id"]] and r["component"] == min(part[r["id"]])
    assert simhash.groups(docs(spark, [])).count() == 0


def test_simhash_links_of_crowded_anchors(spark):
    rng = np.random.default_rng(0)
    centre = int(rng.integers(0, 2**63))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for _ in range(300)} | set(map(int, rng.integers(0, 2**63, 100)))
    fps = [f if f < 2**63 else f - 2**64 for f in fps]
    given = spark.createDataFrame([(f,) for f in fps], "fp long")

    def parts(pairs):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {f: find(f) for f in fps}

    true = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert true
    for cell, wide in ((40, 1000), (2048, 1000), (2048, 1), (7, 1)):  # crowded anchors and not, three blocks and two
        edges = simhash.links(given, 4, cell, wide).collect()
        assert parts([(e["u"], e["v"]) for e in edges]) == parts(true), (cell, wide)


def test_anchors_cover():
    """Whatever differs in at most ``reach`` bits of a block is at home at one of the anchors."""
    rng = np.random.default_rng(4)
    for blocks, reach in ((simhash.FEW, 1), (simhash.MANY, 2)):
        assert sum(b[1] + b[2] for b in blocks) >= 61
        for block in blocks:
            made = simhash.patterns(block, reach)
            fps = rng.integers(0, 2**63, 300).astype(np.uint64)
            others = fps.copy()
            for i in range(len(fps)):
                for bit in rng.choice(block[1] + block[2], reach, replace=False):
                    others[i] ^= np.uint64(1 << int(bit) + block[0])
            _, near = simhash.anchors(fps, block, made)
            home, _ = simhash.anchors(others, block, made)
            assert (near == home[:, None]).any(axis=1).all()


def test_keep_one(spark):
    base = text(4, 2000)
    kept = simhash.keep_one(docs(spark, [(1, base), (2, base), (3, text(5, 100)), (3, text(5, 100)), (None, base), (3, text(6, 100)), (1, text(8, 50)), (9, text(8, 50)), (10, None), (11, ""), (12, " ")]))
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 1, 3, 3, 10] and kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    assert simhash.keep_one(docs(spark, [])).count() == 0


def jaccard(a, b, width=5):
    a, b = ({" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_keep_one_of_edited_copies(spark):
    rng, rows = np.random.default_rng(7), []
    for f in range(60):
        base = text(300 + f, int(rng.integers(60, 400))).split()
        for j in range(4):
            w = list(base)
            for at in rng.choice(len(w), int(len(w) * rng.uniform(0, 0.04)), replace=False):
                w[at] = f"edit{f}x{j}"
            rows.append((len(rows), " ".join(w)))
    pairs = [(a, b) for a, s in rows for b, t in rows if a < b and a // 4 == b // 4 and jaccard(s, t) >= 0.8]
    part = {i: i for i, _ in rows}
    for _ in range(4):
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    assert sum(1 for a, b in pairs if jaccard(rows[a][1], rows[b][1]) < 0.9) > 30
    for follow, side in ((32, 512), (2, 512), (0, 2)):
        got = {r["id"]: r["component"]["id"] for r in simhash.near_groups(docs(spark, rows), follow=follow, part=side).collect()}
        assert got == part
    kept = simhash.keep_one(docs(spark, rows)).collect()
    assert {r["doc_id"] for r in kept} == set(part.values())


def test_keep_one_in_a_crowded_bucket(spark):
    """One passage makes up most of each text: unlike texts share buckets, and links between them are all kept."""
    rng, passage, rows = np.random.default_rng(11), text(900, 150).split(), []
    for f in range(70):
        own = [f"own{f}w{k}" for k in range(int(rng.integers(30, 60)))]
        for j in range(int(rng.integers(1, 4))):
            w = list(own)
            for at in rng.choice(len(w), int(rng.integers(0, 4)), replace=False):
                w[at] = f"edit{f}x{j}"
            rows.append((len(rows), " ".join(passage + w)))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for _, t in rows]
    part = {i: i for i in range(len(rows))}
    pairs = [(a, b) for a in part for b in part if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    for _ in range(len(rows)):
        before = dict(part)
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
        if part == before:
            break
    assert 10 < len(set(part.values())) < len(rows)
    for side in (512, 16):
        got = {r["id"]: r["component"]["id"] for r in simhash.near_groups(docs(spark, rows), follow=4, part=side).collect()}
        assert got == part


def test_keep_one_links_by_simhash(spark):
    """The pipeline takes texts whose fingerprints lie within four bits as near copies, though their sets of shingles are unlike."""
    import corpus_pipeline

    base = text(40, 9) + " "
    rows = [(i, base * 60 + text(50 + i, 20)) for i in range(3)] + [(7, text(60, 90))]
    fps = [simhash.fingerprint(t.encode(), 5) for _, t in rows]
    assert all((fps[0] ^ x).bit_count() <= 4 for x in fps[:3]) and (fps[0] ^ fps[3]).bit_count() > 4
    assert jaccard(rows[0][1], rows[1][1]) < 0.5
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs(spark, rows), "").collect()} == {0, 7}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    vecs = [(i, [float(x) for x in rng.normal(0, 0.4, 8)]) for i in range(120)]
    vecs += [(200 + i, vecs[0][1]) for i in range(20)] + [(300, None), (301, [float("nan")] * 8), (None, vecs[1][1]), (302, [1.0]), (303, [None] * 8), (304, [])]
    given = spark.createDataFrame([(i, v, "x", 1) for i, v in vecs], "vec_id long, embedding array<double>, query string, cls int")
    got = vafile.top_k(given, block=32, queries=2, band=1).collect()
    assert sorted((r["query"], r["rank"], r["id"], r["score"]) for r in got) == nearest(vecs)
    assert vafile.top_k(given.limit(0)).count() == 0


def nearest(vecs, k=5):
    q = {i: [math.floor(256 * x) for x in v] for i, v in vecs if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i in (x for x in q if x % 50 == 0):
        near = sorted((-sum(a * b for a, b in zip(q[i], q[j])), j) for j in q if j != i and len(q[j]) == len(q[i]))[:k]
        out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    return sorted(out)


def test_top_k_of_long_vectors_and_outliers(spark, monkeypatch):
    """Vectors of any length and scale, beyond the sampled cells too, and many copies of one."""
    rng = np.random.default_rng(2)
    vecs = [(i, [float(x) for x in rng.normal(0, 9 if i % 10 else 900, 16)]) for i in range(300)]
    vecs += [(1000 + 25 * i, vecs[3][1]) for i in range(40)] + [(5000 + i, [1e6 * float(x) for x in rng.normal(0, 1, 3)]) for i in range(0, 120, 10)]
    kept = {}
    kept_written = vafile.written

    def note(df, what):
        kept[what] = kept_written(df, what)
        return kept[what]

    monkeypatch.setattr(vafile, "written", note)
    got = vafile.top_k(spark.createDataFrame(vecs, "vec_id long, embedding array<double>"), sample=40).collect()
    assert sorted((r["query"], r["rank"], r["id"], r["score"]) for r in got) == nearest(vecs)
    assert kept["bounds"].count() < 0.5 * kept["asked"].count() * kept["classes"].count()


def test_cells():
    rng = np.random.default_rng(3)
    x = rng.integers(-1000, 1000, (500, 5))
    x[:, 3] = 7
    edges = vafile.cells_of([r.tobytes() for r in x])[5]
    low, high = vafile._lows(edges), vafile._highs(edges)
    for r in x:
        c = vafile._cell(edges, r)
        assert (low[c, range(5)] <= r).all() and (r <= high[c, range(5)]).all()


def vocabulary(spark, counts, **bounds):
    return logbilinear.vocabulary(spark.createDataFrame([(w, n) for w, n in counts.items()], "word binary, n long"), **({"shortlist": 3, "endings": 2, "rest": 2, "head": 4} | bounds))


def test_log_bilinear_sums_to_one(spark):
    counts = {b"a": 9, b"b": 5, b"xing": 4, b"ying": 3, b"zed": 2, b"q": 1, b"r": 1, logbilinear.END: 1}
    v = vocabulary(spark, counts)
    assert v.end < v.short == 3 and len(v.head) <= 5 and (v.tokens, v.types, v.once) == (26, 8, 3)
    p = logbilinear.Parameters.first(logbilinear._noise(v), 4, 1)
    outputs = np.exp(logbilinear.Normaliser(p).log_prob(np.array([[0, 1, w] for w in range(3 + len(v.mass))], np.int32)))
    assert outputs.sum() == pytest.approx(1, abs=1e-5)
    # words outside the shortlist share their class by their counts, and each class's shares sum to one
    import pyarrow as pa

    out, _ = v.outputs(pa.array(list(counts), pa.binary()))
    share = Counter()
    for w, o in zip(counts, out.tolist()):
        if o >= v.short:
            share[o] += (counts[w] + 0.5) / v.mass[o - v.short]
    assert share and all(x == pytest.approx(1) for x in share.values())


def test_log_bilinear_tokens():
    import pyarrow as pa

    said = ["A b\x0bÄ a", None, "", " \t ", "one\ntwo "]
    numbers, types, ends = logbilinear.tokens(pa.array([None if t is None else t.encode() for t in said], pa.binary()))
    names = types.to_pylist()
    got = [[names[i] for i in numbers[a:b]] for a, b in zip([0, *ends], ends)]
    assert got == [[*(t or "").translate(str.maketrans("AB", "ab")).encode().split(), logbilinear.END] for t in said]
    rows = logbilinear._rows(np.arange(10, 10 + len(numbers)) * 0 + np.where(np.isin(np.arange(len(numbers)), ends - 1), 7, numbers), ends, 7)
    firsts = np.concatenate(([0], ends[:-1]))
    assert (rows[firsts, :2] == 7).all()


def test_log_bilinear_learns_from_context(spark):
    """On held-out texts the model is better than the base, on known tokens too."""
    import pyspark.sql.functions as F

    rng = np.random.default_rng(8)
    tongues = [[f"{w}{end}" for w in WORDS[k * 100 : k * 100 + 90]] for k, end in enumerate(("ung", "eau"))]
    rows = [(i, " ".join(rng.choice(tongues[i % 2], 60))) for i in range(400)]
    got = logbilinear.scores(docs(spark, rows), F.col("doc_id") % 5 != 1, shortlist=20, endings=8, rest=4)
    r = got.where("id % 5 = 1").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens"), F.sum("n_known")).first()
    assert r[2] == r[3] and r[0] > r[1] + 0.1 * r[2]


def test_language(spark):
    en, de = "the cat and the dog of this house with that ", "der hund und die katze von dem haus mit das "
    train = spark.createDataFrame([(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    page = lambda said, t: f'<html lang="{said}"><script>der die das</script><p>{t}</p></html>'
    rows = [(1, "https://a.b.de/x", page("de", de)), (2, "http://a.b.de/y", page("en", de * 3)), (3, None, None), (4, "nonsense", page("fr", en)), (5, "http://a.b.de/z", ""), (5, "http://a.b.de/z", "")]
    got = langid.classify(spark.createDataFrame(rows, "page_id long, url string, html string"), langid.fit(train)).collect()
    by = {r["id"]: r for r in got}
    assert len(got) == 6 and (by[1]["lang"], by[2]["lang"], by[4]["lang"], by[5]["lang"]) == ("de", "de", "en", "de")
    assert by[3]["host"] == "" and by[4]["declared"] == "other"
    assert langid.classify(spark.createDataFrame([], "page_id long, url string, html string"), langid.fit(train)).count() == 0


def test_lines(spark):
    passage = " ".join(WORDS[:60])
    own = [f"line {text(100 + i, 12)}\n{text(200 + i, 15)}\n{text(900 + i, 9)}" for i in range(8)]
    rows = [(i, f"{own[i]}\n{passage}\nmoved {i} items to shelf {i * 7} of hall {i} today") for i in range(6)]
    rows += [(20 + i, own[6]) for i in range(5)] + [(40, None), (41, ""), (42, own[7] + "\nAll rights"), (0, rows[0][1])]
    got = {(r["doc_id"], r["__dropped"]): r for r in lines.dedup_lines(docs(spark, rows)).collect()}
    for i in range(6):
        assert got[i, 2]["text"] == own[i]  # the passage, and the template of digits
    assert all(got[20 + i, 0]["text"] == own[6] for i in range(5))  # copies stay for the near-duplicate stage
    assert got[40, 0]["text"] is None and got[41, 0]["text"] == "" and got[42, 0]["fp"] == "clash"
    assert lines.dedup_lines(docs(spark, [])).count() == 0


def test_lines_of_documents_without_other_long_lines(spark):
    one, two = " ".join(WORDS[60:90]), " ".join(WORDS[100:130])
    rows = [(i, f"{one}\nno {WORDS[i]}") for i in range(5)] + [(10 + i, f"{two}\n{WORDS[200 + i]}\n{' '.join(WORDS[140:160])}") for i in range(5)]
    rows += [(20 + i, text(21, 20) + "\n" + text(22, 20)) for i in range(5)]
    got = {r["doc_id"]: r["__dropped"] for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert got == {i: 1 if i < 5 else 2 if i < 15 else 0 for i, _ in rows}


def test_lines_of_few_tokens(spark):
    run = "这是一个没有空格的重复段落它出现在许多不同的文本之中"
    rows = [(i, f"{text(400 + i, 30)}\nAll rights\n\n") for i in range(12)] + [(20 + i, f"{text(500 + i, 30)}\n{run}\nBack") for i in range(4)]
    got = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(spark, rows)).collect()}
    assert all(got[i] == text(400 + i, 30) + "\n\n" for i in range(12)) and all(got[20 + i] == text(500 + i, 30) + "\nBack" for i in range(4))


def test_lines_of_leaves_with_several_templates(spark):
    kinds = ("posted in the forum by user {} about new garden tools", "posted in the shop for buyer {} with free home delivery", "posted in the yard near gate {} under some old trees")
    for sizes in ((8, 8, 0), (12, 8, 0), (8, 8, 8), (9, 3, 3)):
        said = [k.format(WORDS[40 * j + i]) for j, k in enumerate(kinds) for i in range(sizes[j])]
        rows = [(i, f"{text(600 + i, 25)}\n{x}") for i, x in enumerate(said)]
        assert {r["text"] for r in lines.dedup_lines(docs(spark, rows)).collect()} == {text(600 + i, 25) for i in range(len(said))}, sizes
    assert all(r["__dropped"] == 0 for r in lines.dedup_lines(docs(spark, [(i, f"posted in the {text(700 + i, 7)}") for i in range(9)])).collect())


def test_toxicity(spark):
    bad = ["scum", "idiot", "moron"]
    rows = [(i, text(i, 60) + (" " + " x ".join(bad[: 1 + i % 3]) if i % 5 == 0 else "")) for i in range(300)] + [(400, None), (401, ""), (402, "IDIOT, scum! moron"), (402, "baaa bada")]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(250)] + [(None, 0, 1), (7, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(df.where("doc_id < 250"), labels)
    got = toxicity.scores(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    seen = {r["id"]: r["score"] for r in got if r["id"] != 402}
    assert all((seen[i] >= 0.5) == (i % 5 == 0) for i in range(250, 300)) and seen[400] < 0.5
    assert sorted(r["score"] >= 0.5 for r in got if r["id"] == 402) == [False, True]
    # neighbours are exact
    scorer = toxicity.Scorer(model, 300, {})
    q = scorer.index.units([t for t, _ in model.rows], [c for _, c in model.rows])
    who, best = scorer.index.nearest(q)
    sims = np.round(q @ q.T, 9)
    order = np.lexsort((np.broadcast_to(np.arange(len(q)), sims.shape), -sims), axis=1)[:, : model.k]
    assert (np.take_along_axis(sims, order, 1) == best).all() and (who == order)[best > 0].all()
    assert toxicity.drop_toxic(df, model).where("doc_id = 400").count() == 1


def test_apportion():
    rng = np.random.default_rng(3)
    for _ in range(30):
        claims = [float(x) for x in rng.integers(0, 50, rng.integers(1, 8))]
        seats = int(rng.integers(0, 60))
        want = [0] * len(claims)
        if sum(claims):
            for _ in range(seats):
                i = max(range(len(claims)), key=lambda k: (claims[k] / (2 * want[k] + 1), -k))
                want[i] += 1
        assert mixing.apportion(claims, seats) == want
    assert mixing.targets([10, 100, 0], [5, 2, 1]) == [30.0, 80.0, 0.0]


def test_mixing(spark):
    rows = [(i, text(i, 20 + i % 50)) for i in range(500)] + [(900, None), (901, ""), (5, text(5, 25))]
    df = docs(spark, rows).selectExpr("doc_id", "text", "case when doc_id % 4 = 3 then null else source end as source", "1 as size")
    got = mixing.mix(df, shard_docs=50, block=16).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    for s in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == s]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], abs=200)
    assert sorted(map(tuple, mixing.mix(df, shard_docs=50, block=16).collect()), key=str) == sorted(map(tuple, got), key=str)
    assert mixing.mix(df.limit(0)).count() == 0


def edit(a, b):
    """Least edit distance of a to any part of b."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def test_decontaminate(spark):
    item = text(50, 30)
    broken = item[:40] + "X" + item[41:80] + item[82:]
    rows = [(1, text(1, 40) + " " + item.upper() + " " + text(2, 40)), (2, text(3, 10) + "\n" + broken), (3, text(4, 200)), (4, None), (5, ""), (6, item[: len(item) // 2]), (1, item)]
    bench = spark.createDataFrame([(7, item), (8, "short"), (9, None), (7, item)], "item_id long, text string")
    got = decontaminate.matches(docs(spark, rows), bench).collect()
    want = sorted((i, edit(decontaminate.normal(item), decontaminate.normal(t))) for i, t in rows if t and edit(decontaminate.normal(item), decontaminate.normal(t)) <= 5)
    assert sorted((r["id"], r["distance"]) for r in got) == want and len(want) == 3
    blocks = decontaminate.matches(docs(spark, rows), spark.createDataFrame([(i, text(60 + i, 30)) for i in range(9)] + [(7, item)], "item_id long, text string"), block_chars=200)
    assert sorted(r["id"] for r in blocks.collect()) == [1, 1, 2]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()) == [3, 4, 5, 6]


def test_decontaminate_long_short_and_nameless_items(spark):
    long_, nameless = text(80, 200), text(81, 30)
    words = long_.split()
    for at in (20, 70, 120, 170):
        words[at] = "#" * 5
    rows = [(1, text(1, 40) + " " + " ".join(words)), (2, "so: Nine lives, she said"), (3, "canine livestock nine livess"), (4, text(2, 20) + " " + nameless), (5, "他说今天天气很好啊"), (6, text(3, 90))]
    bench = spark.createDataFrame([(1, long_), (2, "nine  lives"), (None, nameless), (3, "今天天气"), (4, " ")], "item_id long, text string")
    got = sorted((r["id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs(spark, rows), bench).collect())
    d = edit(long_, rows[0][1])
    assert 8 < d <= len(long_) * 0.05 and got == [(1, 1, d), (2, 2, 0), (4, None, 0), (5, 3, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_contaminated(docs(spark, rows), bench).collect()) == [3, 6]


def test_myers():
    rng = np.random.default_rng(5)
    for _ in range(40):
        a, b = ("".join(rng.choice(list("abc"), int(rng.integers(1, 90)))) for _ in range(2))
        assert decontaminate.nearest(decontaminate.peq(a), len(a), b)[0] == edit(a, b)


def test_secrets(spark):
    key = "AKIA" + "A1B2" * 4
    rows = [(1, f"é𝄞 password = \"hunter22\" {key} token: abc"), (2, "PassWord=token :abcdefgh API_KEY='zzzzzz9'"), (3, "f" * 30 + " " + "g" * 30), (4, None), (5, ""), (6, "ghp_" + "x1" * 18), (1, "none"), (None, key),
            (7, "-----BEGIN RSA PRIVATE KEY-----")]
    got = secrets.scan(docs(spark, rows)).collect()
    base = {"assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]+"}
    want = []
    for i, t in rows:
        s = [(m.start(), k, m.end()) for k, p in base.items() for m in re.finditer(p, t or "", re.A) if len(m[2] if k == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[k]]
        want.append((i or -1, sorted(s)))
    have = sorted((r["id"] or -1, sorted((x["start"], x["kind"], x["end"]) for x in r["spans"] if x["kind"] in base)) for r in got)
    assert have == sorted(want)
    more = {r["id"]: [x["kind"] for x in r["spans"]] for r in got}
    assert more[6] == ["github"] and more[7] == ["private_key"]
    assert secrets.trigram_query("[0-9a-f]+") == secrets.ANY and secrets.trigram_query("abcd|xyz") == frozenset({frozenset({"abc", "bcd"}), frozenset({"xyz"})})


def test_tool_calls(spark):
    call = lambda i, a: f'<tool_call>{{"id":"{i}","name":"f","arguments":{a}}}</tool_call>'
    back = lambda i: f'<tool_response>{{"id":"{i}","content":"ok"}}</tool_response>'
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "go " + call("a", '{"x":1.0}') + call("b", '{"x":{"$ref":"a"}}')), (1, 2, "tool", back("b") + back("zz")), (1, 3, "tool", back("a")), (1, 4, "assistant", call("a", '{"x":"s"}')),
            (2, 0, "tool", back("q")), (2, 1, "assistant", call("q", '{"y":1}')), (2, 2, "assistant", call("c", '{"x":{"$ref":"d"}}') + call("d", '{"x":{"$ref":"c"}}')), (3, None, None, None), (3, 0, "user", "<tool_call>oops</tool_call>")]
    schemas = {"f": {"type": "object", "properties": {"x": {"type": "integer"}}, "required": ["x"]}}
    got = {(r["conv_id"], r["turn"]): r for r in toolcalls.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), schemas).collect()}
    assert got[1, 1]["message"] == '{"content":"go","role":"assistant","tool_calls":[{"arguments":{"x":1},"id":"a","name":"f","status":"linked"},{"arguments":{"x":{"$ref":"a"}},"id":"b","name":"f","status":"linked"}]}'
    assert got[1, 1]["levels"] == [0, 2] and got[1, 2]["levels"] == [3, None] and got[1, 3]["levels"] == [1]
    assert '"status":"orphan"' in got[1, 2]["message"] and '"status":"duplicate"' in got[1, 4]["message"] and got[1, 4]["n_invalid"] == 1
    assert '"status":"early"' in got[2, 0]["message"] and "$.x: missing" in got[2, 1]["message"] and got[2, 2]["levels"] == [None, None]
    assert got[3, None]["message"] == '{"content":null,"role":null}' and "unreadable" in got[3, 0]["message"]
    assert toolcalls.link(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_held_out(spark):
    import pyspark.sql.functions as F

    from tidemark.llm.common import held_out

    got = spark.range(50).select("id", held_out(F.col("id"), 1).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 1) for r in got)


def test_digest_of_no_spans():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, text(i, 60) + (" scum x idiot x moron" if i % 6 == 0 else "")) for i in range(240)]
    item = text(999, 40)
    rows += [(500, rows[1][1] * 3), (501, rows[1][1] * 3), (502, text(7000, 30) + " " + item)]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert not any(i % 6 == 0 for i in got if i < 240) and 502 not in got and 501 not in got
    kept = [i for i in got if i < 240]
    assert len(kept) > 100  # what the mix takes of the clean ones


def test_toxicity_frequencies(spark):
    """Document frequencies are counted within tasks: a row for each goes on, however many terms the texts hold."""
    terms = {w.encode(): i for i, w in enumerate("abcd")}
    model = toxicity.Model(terms, np.array([1]), np.array([1.0]), np.array([1.0]), [(np.array([0]), np.array([1.0]))], 3, 64)
    texts = ["a a b", "a c x", "", None, "y", "d"] * 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    rows, scorer = toxicity._frequencies(docs, model, "doc_id", "text")
    n = [100, 50, 50, 50, 100]
    assert np.allclose(scorer.index.idf, [np.log(301 / (1 + x)) + 1 for x in n])
    tasks = rows.rdd.getNumPartitions()
    assert rows.select("terms").mapInArrow(lambda b: toxicity._tallies(b, 5, toxicity.ADDERS), "part int, n binary").count() == tasks
    empty = toxicity._frequencies(docs.limit(0), model, "doc_id", "text")[1]
    assert np.allclose(empty.index.idf, np.log(1.0) + 1)
