"""The corpus operators: odd rows for each, and brute force, round trips or held-out accuracy."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from marginmill.llm import chat, decontaminate, jaccard, langid, linededup, mixing, quality, queries, sharding, shared, urlfilter, warc

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, shard string, copies string, _h string"


def lower(x):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in x or "")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "s", 0), (3, " \t\n", "en", "s", 3), (4, "one two", "en", "s", 7), (4, "one two", "en", "s", 7), (5, "one two", None, "t", 7),
        (None, "no id at all here", "en", "s", 5), (6, long, "en", "t", 9), (7, long, "en", "t", 9), (8, "123 456", "en", None, 7), (9, "é à\nü\n" * 40, "fr", "t", 1),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOC)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def components_by_force(rows, k, num):
    sets = defaultdict(list)
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets[i].append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= num * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80)])
def test_jaccard_by_force(spark, docs, k, num):
    extra = [(10_000 + i, " ".join(f"v{j}" if j != i else "other" for j in range(60)), "en") for i in range(40)]  # near copies of one text
    for i in range(12):  # large sets: near copies, and strangers that share a third
        base = [f"{'s' if j < 700 else 'u' + str(i // 3)}{j}" for j in range(2000)]
        extra.append((11_000 + i, " ".join("edit" if j % 90 == i % 3 else w for j, w in enumerate(base)), "en"))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [x[:2] for x in extra]
    all_docs = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    got = jaccard.JaccardJoin(all_docs, k, num).components().collect()
    want = components_by_force(rows, k, num)
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)


def test_jaccard_links(spark):
    base = [f"a{j}" for j in range(50)]
    rows = [(i, " ".join(base[:i] + ["x"] + base[i + 1 :] if i else base)) for i in range(6)]
    got = {(r.a, r.b) for r in jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).links().collect()}
    sets = [{tuple(t.split()[j : j + 3]) for j in range(48)} for _, t in rows]
    assert got == {(a, b) for a in range(6) for b in range(a + 1, 6) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])}


@pytest.mark.parametrize("hot", [500, 3])
def test_jaccard_hot_tokens(spark, hot, monkeypatch):
    """Sets of many sizes that share frequent shingles, some linked, paired as one block or as many; a doc_id repeated 1000 times."""
    monkeypatch.setattr(jaccard, "HOT_TOKEN", hot)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    rng = np.random.default_rng(4)
    common = [f"c{i}" for i in range(12)]
    rows = [(i, " ".join([*common, *(f"x{rng.integers(8)}" for _ in range(rng.integers(0, 5)))])) for i in range(120)]
    rows += [(500, " ".join(common)), (500, " ".join([*common, "z"]))] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = components_by_force(sorted(set(rows)), 2, 80)
    got = jaccard.JaccardJoin(df, 2, 80).components().collect()
    assert len(got) == len(rows) and all(r.component_id == want[r.doc_id] for r in got)
    sets = {i: {tuple(t.split()[j : j + 2]) for j in range(len(t.split()) - 1)} for i, t in rows if i < 500}
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in got if r.doc_id < 500)
    firsts = {}
    for i, x in sorted(sets.items()):
        firsts.setdefault(frozenset(x), i)
    ids = sorted(firsts.values())
    links = {(r.a, r.b) for r in jaccard.JaccardJoin(df.where("doc_id < 500"), 2, 80).links().collect()}
    assert links == {(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}


def test_jaccard_one_of_each_without_ids(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(None, words), (None, words), (3, words + " more"), (None, "other words stand here alone"), (None, "other words stand here alone"), (None, None), (None, "")]
    got = jaccard.one_of_each(spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, root string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == [(0, ""), (0, ""), (0, "other words stand here alone"), (3, words + " more")]


def test_op5_by_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = components_by_force(rows, 3, 90)
    for r in queries.op5_ngram_jaccard(spark, SF).collect():
        w = WORD.findall(lower(dict(rows)[r.doc_id]))
        assert r.component_id == want[r.doc_id] and r.n_shingles == (len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) if len(w) > 2 else min(len(w), 1))


def test_jaccard_odd(spark, odd):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.JaccardJoin(odd, 3, 90).components().collect()]
    by = dict((x[0], x[1:]) for x in got)
    assert len(got) == 11 and by[1] == (0, 1) and by[2] == (0, 2) and by[4] == by[5] == (1, 4) and by[7][1] == 6 and by[None][1] is None
    assert jaccard.JaccardJoin(odd.limit(0)).components().count() == 0
    assert sorted(r.doc_id or 0 for r in jaccard.one_of_each(odd).collect()) == [0, 1, 2, 3, 4, 4, 6, 8, 9]  # rows that repeat a doc_id are one document


def test_jaccard_bridge_without_id(spark):
    """Two documents that link only to one without doc_id are one component."""
    words = [f"w{i}" for i in range(10)]
    rows = [(1, " ".join(words[:9])), (None, " ".join(words)), (None, " ".join(words)), (2, " ".join(words[1:]))]
    got = jaccard.JaccardJoin(spark.createDataFrame(rows, "doc_id long, text string"), 1, 85).components().collect()
    assert len(got) == 4 and {r.component_id for r in got} == {1}


def test_join_counted(spark):
    """Keys on both sides of the limit, and one that the table lacks."""
    rows = spark.range(3000).select(F.when(F.col("id") < 1500, 0).when(F.col("id") < 2999, F.col("id") % 7 + 1).otherwise(99).alias("k"), "id")
    table = rows.where("k <> 99").groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("top"))
    got = shared.join_counted(rows, table, ["k"], "n", 3000)
    want = rows.join(table, "k")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_language(spark, odd):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op1_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(out) > 200 and np.mean([r.lang == r.lang_pred for r in out]) > 0.98 and all(0 <= r.score <= 1 for r in out)
    model = langid.train(d.select("doc_id", "text", "lang"))
    by = {r.doc_id: r for r in langid.identify(odd.withColumn("score", F.lit("old")), model).collect()}
    assert {by[i].lang_pred for i in (1, 2, 3, 8)} == {"und"} and by[4].lang_pred in model.languages
    empty = langid.train(odd.limit(0))
    assert langid.identify(odd.limit(0), empty).count() == 0 and langid.identify(odd, empty).where("lang_pred <> 'und'").count() == 0
    # counts don't depend on the blocks; a mix of languages and a tie are ambiguous
    body = next(r.text for r in d.select("text").collect() if len(r.text) > 3000)
    assert all((langid.grams(body, n) == langid.grams(body)).all() for n in (1, 2, 7, 64, 1000))
    of = {x: " ".join(r.text for r in d.where(F.col("lang") == x).orderBy("doc_id").limit(20).collect())[:4000] for x in model.languages}
    plain = {x: model.decode(langid.grams(t)) for x, t in of.items()}
    assert all(plain[x][0] == x and not plain[x][2] for x in of) and 1 < model.margin <= langid.MARGIN
    mixed = [model.decode(langid.grams(of[a][:k] + " " + of[b][: 2000 - k])) for a in of for b in of if a < b for k in range(0, 2001, 25)]
    assert any(x[2] for x in mixed)
    tie = langid.Model(["a", "b"], langid.codewords(2), np.zeros((langid.BUCKETS, 1)), np.zeros(1), np.ones(1), np.ones(1))
    assert tie.decode(langid.grams("some text")) == ("a", 0.5, True)
    many = langid.train(spark.createDataFrame([(i, f"word{i % 600}x y{i}", f"l{i % 600}") for i in range(6000)], "doc_id long, text string, lang string"))
    assert len(many.languages) == 600  # no language is left out
    code = langid.codewords(20)
    assert min(int((code[a] != code[b]).sum()) for a in range(20) for b in range(a)) >= 8


def rule_by_force(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3 :] if at >= 0 else ""
    host, path = re.match(r"[^/?#]*", rest)[0], re.match(r"[^/?#]*([^?#]*)", rest)[1]
    host = lower(host)
    fit = [(len(h + p), len(p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[2:] if fit else (None, "allow")))


def test_urls(spark):
    pages = [(1, "http://A.Example.com/en/7x?q"), (2, None), (3, "no scheme"), (4, "x://example.net/de/8"), (4, "x://example.net/de/8"), (5, "https://notcom/en/1"), (None, "s://com/en/"), (6, "a://b.org#f"), (7, "a://b.org/es/" + "p" * 5000), (8, "a://..com/en/1"), (9, "")]
    df = spark.createDataFrame([(*p, "clash", "c", "k") for p in pages], "page_id long, url string, rule string, salt string, key string")
    rules = spark.createDataFrame(queries.URL_RULES + [(None, "/", "block"), ("com", "/en/", "allow")], "host string, path string, verdict string")
    got = sorted((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(df, rules).collect())
    assert got == sorted((i or 0, *rule_by_force(u, queries.URL_RULES)) for i, u in pages)
    assert urlfilter.judge(df.limit(0), rules).count() == 0 and urlfilter.judge(df, rules.limit(0)).count() == len(pages)
    assert {r.verdict for r in urlfilter.judge(df, rules.limit(0), "block").collect()} == {"block"}


@pytest.mark.parametrize("host_rules", [64, 2])
def test_urls_by_force(spark, host_rules):
    """Nested hosts and paths, a hot host and a hot url, hosts with many rules, over many ranges."""
    rng = np.random.default_rng(3)
    names, parts = ["a", "b", "ab", "c-d", "com"], ["", "/", "/x", "/x/y", "/x/yz", "/z?q", "/x/y/z#f"]
    word = lambda: ".".join(rng.choice(names, rng.integers(1, 4)))
    rules = {(word(), str(rng.choice(["", "/", "/x", "/x/", "/x/y", "/z"]))): str(rng.choice(["allow", "block"])) for _ in range(60)}
    rules |= {("a.com", f"/x/y{i}"): "block" for i in range(90)}
    rules = [(*k, v) for k, v in rules.items()]
    pages = [(i, f"http://{word()}{rng.choice(parts)}{i % 97 if i % 3 else ''}") for i in range(1500)] + [(5000 + i, "h://b.a.com/x/y7/deep") for i in range(400)] + [(None, "h://b.a.com/x/y7/deep")] * 3
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that there are several ranges
    try:
        out = urlfilter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), host_rules=host_rules).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    key = lambda r: repr(tuple(r))
    assert sorted(map(key, out)) == sorted(key((i, *rule_by_force(u, rules))) for i, u in pages)


def test_warc(spark):
    rows = [(1, "http://a.b/x", "same"), (2, None, "same"), (3, "http://a.b/x", None), (4, "http://c.d/é\t", ""), (5, "http://c.d/", "x" * 300_000), (6, "http://a.b/x", "same"), (None, "http://e/", "same")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, key string")
    got = {r.page_id: r for r in warc.archive_and_read(df).collect()}
    assert len(got) == 7 and got[1].record_type == "response" and got[2].refers_to == got[6].refers_to == got[None].refers_to == 1 and got[4].refers_to == 3
    assert got[5].payload_bytes == 300_000 and got[1].payload_digest == __import__("base64").b32encode(hashlib.sha1(b"same").digest()).decode()
    assert warc.archive_and_read(df.limit(0)).count() == 0
    assert warc.url_key("http://WWW.Ex.com/A?b#c") == "com,ex,www)/A?b"


def test_warc_blocks_and_files(spark):
    """Many blocks and files, one url with many pages, repeated and null page_ids: each record once."""
    rows = [(i, f"http://h{i % 7}.org/{i % 90}" if i % 3 else "http://hot.org/", f"page {i % 50}") for i in range(600)] + [(7, "http://hot.org/", "again")] * 2 + [(None, "http://hot.org/", f"n{i}") for i in range(5)]
    df, folder = spark.createDataFrame(rows, "page_id long, url string, html string"), shared.work_folder(spark)
    captures = warc.write_archives(df.repartition(3), folder, file_bytes=5_000)
    assert captures.select("archive").distinct().count() > 10
    got = warc.lookup(captures, folder, warc.build_index(captures, folder, block_lines=8), read_bytes=20_000)
    assert got.rdd.getNumPartitions() > 3
    digest = lambda x: __import__("base64").b32encode(hashlib.sha1(x.encode()).digest()).decode()
    assert Counter((r.page_id, r.payload_digest) for r in got.collect()) == Counter((i, digest(h)) for i, _, h in rows)
    one = warc.lookup(captures.where("page_id = 7").select("key", "page_id"), folder, warc.build_index(captures, folder, block_lines=3))
    assert one.count() == 3


def test_sharding(spark, odd):
    out = sharding.shard_rows(odd, 4).collect()
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [2, 3, 3, 3] and all(sorted(s) == list(range(len(s))) for s in slots.values())
    big = spark.range(3000).repartition(7)
    a, b = (sorted(map(tuple, sharding.shard_rows(x, 7, local_rows=100).collect())) for x in (big, big.repartition(3)))
    assert a == b and max(Counter(x[1] for x in a).values()) - min(Counter(x[1] for x in a).values()) <= 1
    assert abs(np.corrcoef([x[0] for x in a], [x[1] for x in a])[0, 1]) < 0.08
    m, sizes = sharding.communication_matrix([5, 0, 7, 11], 3, 1)
    assert m.sum(0).tolist() == sizes and m.sum(1).tolist() == [5, 0, 7, 11]
    rng = np.random.default_rng(1)
    assert abs(np.mean([sharding._split(rng, 2 * 10**9, 10**9, 3000) for _ in range(300)]) - 2000) < 6
    assert sharding.shard_rows(odd.limit(0), 4).count() == 0


def test_sharding_parts_equal_rows(spark):
    """Three copies of 2000 ids over 40 shards: all three in one shard as seldom as by chance, and a row repeated 120000 times."""
    ids = spark.range(2000).select(F.col("id").alias("row"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("_c")).select("row")
    where = defaultdict(list)
    for r in sharding.shard_rows(ids, 40).collect():
        where[r.row].append(r.shard)
    apart = Counter(len(set(v)) for v in where.values())
    assert len(where) == 2000 and apart[1] <= 8 and 1780 < apart[3] < 1920  # expected: 1.25 and 1852.5
    same = spark.range(120_000).select(F.lit("x").alias("text"))
    got = sharding.shard_rows(same, 7).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("a"), F.max("slot").alias("b"), F.countDistinct("slot").alias("d")).collect()
    assert sum(r.n for r in got) == 120_000 and all(r.a == 0 and r.b == r.n - 1 and r.d == r.n and r.n in (17142, 17143) for r in got)


def test_op4_by_force(spark, docs):
    import zlib

    out = queries.op4_shard(spark, SF).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == want and {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(40)) and all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_lines(spark, odd):
    block = "\n".join(f"this is the shared line number {i} of a long passage." for i in range(14))
    rows = [(1, "own start here.\n" + block + "\nown end of one."), (2, block), (3, "something else.\nand nothing more."), (4, None), (None, block), (5, "x " * 60), (6, "y\n" + "x " * 60)]
    got = {r.doc_id: r for r in linededup.without_repeats(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_lines int")).collect()}
    assert got[1].n_removed_lines == 0 and got[2].n_removed_lines == 14 and got[None].n_removed_lines == 14 and got[3].clean_text == rows[2][1] and got[4].clean_text is None
    assert got[5].n_removed_lines == 0 and got[6].clean_text == "y"
    assert linededup.without_repeats(odd).count() == 11 and linededup.without_repeats(odd.limit(0)).count() == 0
    for body in ("", "a", "a\n", block + "\n\n" + block):
        assert "\n".join(x for lines, _ in linededup.chunks(body) for x in lines) == body


def repeats_by_force(rows):
    """Clean texts of (doc_id, text) rows: every span's text in a dictionary, in order."""
    order = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, linededup_hash(r[1])))
    first, out = {}, {}
    for k, (_, body) in enumerate(order):
        lines, found = linededup.spans(body or "", 50)
        for at, end in sorted(found):
            first.setdefault("\n".join(lines[at:end]), (k, at))
    for k, (doc_id, body) in enumerate(order):
        lines, found = linededup.spans(body or "", 50)
        gone = set()
        for at, end in found:
            d, place = first["\n".join(lines[at:end])]
            if not (d == k and at < place + end - at):
                gone.update(range(at, end))
        out[doc_id, body] = None if body is None else ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def linededup_hash(body):
    """Spark's xxhash64 of a text, the order of documents that share a doc_id."""
    return hashes[body]


hashes = {}


@pytest.mark.parametrize("bits", [128, 3])
def test_lines_by_force(spark, docs, odd, bits):
    rng = np.random.default_rng(9)
    line = lambda: " ".join(f"w{x}" for x in rng.integers(0, 4, rng.integers(0, 30)))
    pool = [line() for _ in range(12)]
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(r.doc_id, r.text) for r in odd.collect()]
    rows += [(int(rng.integers(3000, 3040)) if k % 5 else None, "\n".join(rng.choice(pool, rng.integers(1, 9)))) for k in range(120)]
    rows += [(i, "\n".join(f"passage {j} of the shared text." for j in range(12))) for i in range(4000, 4300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, t string")
    hashes.update({r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).distinct().collect()})
    want = repeats_by_force(rows)
    got = linededup.without_repeats(df, bits=bits).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows)
    for r in got:
        assert want[r.doc_id, r.text] == (None if r.text is None else (r.clean_text, r.n_lines, r.n_removed_lines))


def test_decontaminate(spark, odd):
    item = " ".join(f"item{i}" for i in range(40))
    edited = " ".join("changed" if i % 7 == 3 else f"item{i}" for i in range(40) if i % 11 != 5)
    other = " ".join(f"plain{i}" for i in range(200))
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (None, item, 0), (3, "", 0), (4, "item1 item2", 0)], "item_id long, text string, score int")
    rows = [(1, other + " " + item), (2, other + " " + edited + " " + other), (3, other), (4, " ".join(f"item{i}" for i in range(6)) + " " + other)]
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert set(got) == {(1, 1), (2, 1), (1, 4), (2, 4), (4, 4)} and got[1, 1] == got[4, 4] == 1.0 and 0.6 < got[2, 1] < 0.95  # a short item counts where it stands whole
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(odd, bench.limit(0)).count() == 0
    assert decontaminate.without_benchmark(odd, bench).count() == 11
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.integers(0, 4, 9), rng.integers(0, 4, 14)
        h = np.zeros((10, 15), int)
        for i in range(9):
            for j in range(14):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, matched, first, last = decontaminate.align(a, b)
        assert score == h.max() and (not score or 2 * matched - score >= 0 and first <= last and score == decontaminate.align(a, b[first : last + 1])[0])


def test_decontaminate_long(spark):
    """An item of 10,000 words, edited and after 40,000 others, within bounded memory; short items; very long texts."""
    import tracemalloc

    rng = np.random.default_rng(2)
    item = rng.integers(0, 2**60, 10_000).astype(np.uint64)
    part = np.concatenate([rng.integers(0, 2**60, 20_000).astype(np.uint64), np.delete(item, np.arange(7, 10_000, 50))])
    tracemalloc.start()
    points, matched, first, last = decontaminate.align(item[:3000], part)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20e6 and matched > 2900 and first == 20_000 and points > 0.9 * 6000
    words = [f"i{k}" for k in range(2_500)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "one"), (3, "two words"), (4, "a b c d"), (5, "a b c d")], "item_id long, text string")
    rows = [(1, " ".join([*(f"x{k}" for k in range(30_000)), *(w if k % 9 else "edit" for k, w in enumerate(words))])), (2, "only one here and two  Words\na b c"), (3, "a b c\nd one one"), (4, "nothing")]
    got = {(r.doc_id, r.item_id, r.score == 1, r.first_word) for r in decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench, block_items=2).collect()}
    assert got == {(1, 1, False, 30_001), (2, 2, True, 1), (2, 3, True, 4), (3, 2, True, 4), (3, 4, True, 0), (3, 5, True, 0)}


@pytest.mark.parametrize("n,words", [(2, 30), (3, 20), (5, 12), (6, 10), (10, 10)])
def test_lines_short_passages(spark, n, words):
    """Passages of over 50 words in a few lines go whole between any neighbours, and nothing else does."""
    line = lambda key: " ".join(f"{key}x{k}" for k in range(words))
    rows, passages = [], 25
    for i in range(2 * passages):
        passage = [line(f"p{i % passages}l{j}") for j in range(n)]
        rows.append((i, "\n".join([*(f"own {i} {j}" for j in range(i % 4 + 1)), *passage, *(f"end {i} {j}" for j in range(3))])))
    for r in linededup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.n_removed_lines == (n if r.doc_id >= passages else 0)
        assert r.clean_text.split("\n") == [x for x in r.text.split("\n") if r.doc_id < passages or x[0] != "p"]
    same = linededup.without_repeats(spark.createDataFrame([(1, "\n".join([line("a")] * 4 * n))], "doc_id long, text string")).first()
    assert same.n_lines - same.n_removed_lines >= 2  # of windows that overlap the first stays


@pytest.mark.parametrize("times", [11, 1000])
def test_decontaminate_leaked_often(spark, times):
    """An edited and a half copy are found however many documents hold them."""
    item = [f"item{i}" for i in range(40)]
    half, edited = item[:20] + [f"rest{i}" for i in range(20)], [w if i % 4 else "changed" for i, w in enumerate(item)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    for copy in (half, edited):
        rows = [(i, " ".join([f"own{i}", *copy, f"end{i}"])) for i in range(times)] + [(times, "clean words only")]
        got = decontaminate.contaminated(frame(rows), frame([(1, " ".join(item))]).withColumnRenamed("doc_id", "item_id")).collect()
        assert {r.doc_id for r in got} == set(range(times)) and len(got) == times


def test_decontaminate_by_force(spark):
    """Items of 8 to 40 words with spread edits, among others' words: every pair that a whole alignment finds."""
    rng = np.random.default_rng(5)
    items = {i: [f"i{i}w{j}" if rng.random() < 0.8 else f"the{rng.integers(3)}" for j in range(int(rng.choice([8, 11, 12, 15, 40])))] for i in range(30)}
    items[30] = [f"k{j}" for j in range(11)]
    items[31] = [f"q{j}" for j in range(8)]
    docs = {2000 + d: ["more", *items[31][:3], f"m{d}"] for d in range(12)}
    docs |= {1002: ["one", *items[31][:4], "seed"]}  # the rare part is a single pair
    docs |= {1000: ["a", *("x" if j in (2, 6, 9) else w for j, w in enumerate(items[30])), "b"], 1001: [x for w in items[30] for x in (w, "y")]}
    for d in range(300):
        body = [f"the{rng.integers(3)}" if rng.random() < 0.3 else f"v{rng.integers(999)}" for _ in range(60)]
        part = []
        for w in items[d % 30]:
            part += [] if (u := rng.random()) < 0.08 else [w, "plus"] if u < 0.16 else [w] if u < 0.7 else ["new"]
        docs[d] = body[:30] + part + body[30:]
    number = {w: k for k, w in enumerate({w for x in (*items.values(), *docs.values()) for w in x})}
    coded = lambda x: np.array([number[w] for w in x])
    want = {(d, i): s for d, x in docs.items() for i, y in items.items() if (s := decontaminate.align(coded(y), coded(x))[0] / (2 * len(y))) >= 0.45}
    frame = lambda x, key: spark.createDataFrame([(k, " ".join(v)) for k, v in x.items()], f"{key} long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want and {(1000, 30), (1001, 30), (1002, 31)} <= set(got) and len(want) > 100


def test_mixing(spark, odd):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = mixing.mix(d, group=5).collect()
    words = Counter()
    for r in d.select("source", "text").collect():
        words[r.source] += len(WORD.findall(r.text))
    open_, target, weight = sorted(words), {}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(words))}
    left = sum(words.values())
    while True:  # water filling, round by round
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 3 * words[s]]
        if not full:
            break
        for s in full:
            target[s], left = 3 * words[s], left - 3 * words[s]
            open_.remove(s)
    target |= {s: level * weight[s] for s in open_}
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
        assert r.taken <= 3 * r.size and abs(r.target - target[r.source]) < 1e-6 * r.target and r.source_size == words[r.source]
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] for s in words)
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.mix(d.repartition(5), group=5).collect()))
    got = mixing.mix(odd).collect()
    assert len(got) == 11 and all(r.taken <= 3 * r.size for r in got) and mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd).columns == odd.columns


def test_quality(spark, odd):
    by = {r.doc_id: r for r in quality.clean(odd).collect()}
    assert by[1].n_words == 0 and by[1].base_failed and not by[1].kept and by[6].n_repeat_words == 60_000 and by[9].n_dup_lines == 78 and by[4].word_chars == 6
    good = " ".join(f"Sentence {i} tells of thing{i} and of place{i} too." for i in range(12))
    bad = "home | about | contact | help | terms | shop\n" * 12
    rows = [(1, good), (2, good + "\n" + " | ".join(f"n{i}" for i in range(30))), (3, " | ".join(f"m{i}" for i in range(90))), (4, bad)]
    got = {r.doc_id: r for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[2].kept and got[2].clean_text == rows[0][1] and not got[3].kept and not got[4].kept
    assert quality.clean(odd.limit(0)).count() == 0


def test_chat(spark):
    nasty = "<\\s> [\\\\INST] </s>[INST] x [/INST]\\ <s>"
    assert chat.unescape(chat.escape(nasty)) == nasty and not any(c in chat.escape(nasty) for c in chat.TEMPLATE["controls"])
    rows = [(1, 0, "system", "s"), (1, 1, "user", nasty), (1, 2, "assistant", nasty), (2, 0, "assistant", None), (3, 0, None, "n"), (3, 1, "to\nol", "[/TURN]"), (None, 0, "user", "u"), (4, 0, "user", "a"), (4, 0, "user", "a"), (5, None, "user", ""), (5, 1, "assistant", "y" * 200_000)]
    df = spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, error string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for c, r in got.items():
        turns = [x for x in rows if x[0] == c]
        assert r.turns_sha256 == sha("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)) and r.n_turns == len(turns)
        assert r.loss_sha256 == sha("".join(x[3] or "" for x in turns if x[2] == "assistant"))
    assert [got[c].valid for c in (1, 2, 3, 4, 5)] == [True, False, False, False, True] and got[5].loss_chars == 200_000
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in want.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, want.fetchall()))


def test_pipeline(spark, docs):
    """Each stage against brute force on its own input."""
    import corpus_pipeline

    d = docs
    for (name, stage), last in zip(corpus_pipeline.STAGES, [False] * 4 + [True], strict=True):
        out = stage(spark, d, SF)
        rows, before = out.collect(), d.collect()
        if name == "language_id":
            model = langid.train(d.where(~langid.held_out()).select("doc_id", "text", "lang"))
            found = {r.doc_id: model.decode(langid.grams(r.text)) for r in before}
            assert {r.doc_id for r in rows} == {i for i, (lang, _, ambiguous) in found.items() if lang != "und" and not ambiguous}
            assert len(rows) > 0.98 * len(before) and all(r.lang for r in rows)
        if name == "near_copies":
            assert sorted(r.doc_id for r in rows) == sorted(i for i, c in components_by_force([(r.doc_id, r.text) for r in before], 5, 80).items() if i == c)
        if name == "benchmark_copies":
            items = [lower(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {r.doc_id for r in before} - {r.doc_id for r in rows} >= {r.doc_id for r in before if any(" ".join(WORD.findall(i)) in " ".join(WORD.findall(lower(r.text))) for i in items)}
            assert len(rows) > 0.8 * len(before)
        if name == "mix":
            assert max(Counter(r.doc_id for r in rows).values()) <= 3
        if last:
            sizes = Counter(r.shard for r in rows)
            assert len(rows) == len(before) and max(sizes.values()) - min(sizes.values()) <= 1
        else:
            assert out.columns == docs.columns
        d = spark.createDataFrame(rows, out.schema)
    assert "pipeline" in __spark_entry__.queries()
