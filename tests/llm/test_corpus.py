"""The corpus operators against brute force, on small tables with everything odd in them."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftgraph.llm import bpe_count, components, decontaminate, exact_dedup, html_extract, langid, packing, repeats, simhash, sstable, tokens, url_filter
from weftgraph.llm.shared import new_dir

VOCABULARY = tokens.default_vocabulary()
#: Names that the operators use inside, as columns of the input.
CLASHES = "id string, kept string, digest string, best string, n string, salt string, fp string, uid string, grp string, ids string, score string, lang_pred string, runs string, key string"


def texts(seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta", "über", "naïve", "the", "of"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    out = [None, "", "", "   ", "x", prose(5), prose(5000), "a" * 3000, "ab " * 700, passage, passage, passage + "!", prose(30) + " " + passage + " " + prose(30), prose(20) + passage]
    out += [prose(rng.randint(1, 200)) for _ in range(12)]
    return out + [out[-1], out[-2], "1 2 3 !!", "日本語のテキスト。" * 20, "say <|endoftext|> twice <|endoftext|>", "\0\x85  odd ퟿"]


@pytest.fixture(scope="module")
def rows():
    out = [(i * 3 - 9, t) for i, t in enumerate(texts())]
    return out + [out[9], (None, "no number"), (None, None)]  # a repeated row, null ids


@pytest.fixture(scope="module")
def docs(spark, rows):
    names = CLASHES.split(", ")
    data = [(i, t, *(["clash"] * len(names))) for i, t in rows]
    return spark.createDataFrame(data, f"doc_id bigint, text string, {CLASHES}").repartition(3)


@pytest.fixture(scope="module")
def unique(rows):
    return {i: t or "" for i, t in rows if i is not None}


def empty(docs):
    return docs.where("false")


def expected_ids(text, end):
    return np.array([*tokens.library_tokenizer(VOCABULARY).encode(text, add_special_tokens=False).ids, end], "<u4")


def test_ids_and_counts_are_the_library_s(rows):
    count = bpe_count.counter(VOCABULARY)
    for _, t in rows:
        want = tokens.library_tokenizer(VOCABULARY).encode(t or "", add_special_tokens=False).ids
        assert tokens.encode(t or "", VOCABULARY).tolist() == want and count(t or "") == len(want)


def test_every_code_point_is_split_as_the_library_splits_it():
    count, lib = bpe_count.counter(VOCABULARY), tokens.library_tokenizer(VOCABULARY)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4096):
        text = "".join(f"a{chr(c)}1{chr(c)}!{chr(c)}\n" for c in points[at : at + 4096])
        want = lib.encode(text, add_special_tokens=False).ids
        assert count(text) == len(want) and tokens.encode(text, VOCABULARY).tolist() == want


def test_merges_against_a_plain_loop():
    rng = random.Random(1)
    ranks = {}
    for a in range(6):
        for b in range(6):
            if rng.random() < 0.6:
                ranks[a, b] = (len(ranks), 6 + len(ranks) % 5)
    for a in range(6, 11):
        for b in range(11):
            if rng.random() < 0.3:
                ranks[a, b] = (len(ranks) + 100, 11)
    for _ in range(200):
        symbols = [rng.randrange(6) for _ in range(rng.randrange(30))]
        plain, merges = list(symbols), 0
        while found := [(ranks[p][0], i) for i, p in enumerate(zip(plain, plain[1:])) if p in ranks]:
            _, i = min(found)
            plain[i : i + 2] = [ranks[plain[i], plain[i + 1]][1]]
            merges += 1
        assert bpe_count.count_merges(list(symbols), ranks) == merges


def test_token_counts(docs, rows):
    found = bpe_count.count_tokens(docs)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    want = sorted((str(i), len((t or "").encode()), len(expected_ids(t or "", 0)) - 1) for i, t in rows)
    assert sorted((str(r[0]), r[1], r[2]) for r in found.collect()) == want
    assert bpe_count.count_tokens(empty(docs)).count() == 0


def test_packing(docs, rows):
    found = packing.pack(docs, capacity=64, group_bytes=20_000, min_cut=8).collect()
    by_sequence, by_doc = {}, {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append((r["start"], bytes(r["ids"]), r["doc_tokens"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 64
    wanted = {}
    for i, t in rows:
        wanted.setdefault(i, []).append(expected_ids(t or "", 0).tobytes())
    for i, docs_of in wanted.items():
        pieces = by_doc.pop(i)
        assert sum(len(x) for _, x, _ in pieces) == sum(map(len, docs_of))
        if len(docs_of) == 1:
            assert b"".join(x for _, x, _ in sorted(pieces)) == docs_of[0] and {4 * n for _, _, n in pieces} == {len(docs_of[0])}
    assert not by_doc
    assert packing.pack(empty(docs)).count() == 0


def test_first_fit_decreasing_against_a_scan():
    rng = random.Random(5)
    for _ in range(50):
        lengths = [rng.randint(1, 40) for _ in range(rng.randrange(60))]
        free, want = [], {}
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
            free[b:] = free[b:] or [40]
            free[b] -= lengths[i]
            want[i] = b
        assert packing.first_fit_decreasing(lengths, 40) == [want[i] for i in range(len(lengths))]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, docs, rows, weak):
    digest = (lambda c: F.lpad(F.hex(F.crc32(c) % 3), 4, "0")) if weak else exact_dedup.sha256
    found = exact_dedup.dedup_table(docs, digest=digest).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = sorted((str(i), str(max([x for x in groups[t or ""] if x is not None], default=None)), len(groups[t or ""])) for i, t in rows)
    assert sorted((str(r["id"]), str(r["keep_id"]), r["group_size"]) for r in found) == want
    assert sum(r["kept"] for r in found) == len(groups)
    left = exact_dedup.dedup(docs, digest=digest)
    assert left.columns == docs.columns and sorted((r["text"] or "") for r in left.collect()) == sorted(groups)
    assert exact_dedup.dedup_table(empty(docs)).count() == 0 and exact_dedup.dedup(empty(docs)).count() == 0


def test_hot_digests_and_many_hits(spark, docs, rows):
    for options in ({"hot_rows": 2}, {"hot_rows": 3, "small_hits": 0}, {"hot_rows": 1000, "small_hits": 0, "batches": 1}):
        found = exact_dedup.dedup_table(docs, **options).collect()
        assert len(found) == len(rows) and sum(r["kept"] for r in found) == len({t or "" for _, t in rows})


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_state_goes_on(spark, tmp_path, weak):
    """Two runs and a repeated one over one state folder: later winners, hits on texts of an earlier run, nothing counted twice."""
    digest = (lambda c: F.lpad(F.hex(F.octet_length(c) % 2), 4, "0")) if weak else exact_dedup.sha256
    state = f"file://{tmp_path}/state"

    def saved(name, data):
        path = f"file://{tmp_path}/{name}"
        spark.createDataFrame(data, "doc_id bigint, text string").repartition(3).write.parquet(path)
        return spark.read.parquet(path)

    first, second = [(1, "a text"), (2, "other "), (3, "a text"), (4, None), (5, "single")], [(9, "a text"), (0, "other "), (8, ""), (7, "brand new"), (6, "single?")]
    one, two = saved("one", first), saved("two", second)

    def result(docs):
        return {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.dedup_table(docs, digest=digest, state_dir=state).collect()}

    def wanted(of, among):
        groups = {}
        for i, t in among:
            groups.setdefault(t or "", []).append(i)
        return {i: (max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""])) for i, t in of}

    assert result(one) == wanted(first, first)
    assert result(two) == wanted(second, first + second)
    assert result(two) == wanted(second, first + second)
    assert result(one) == wanted(first, first + second)


def plain_fingerprint(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {n: find(n) for n in nodes}


def test_simhash(docs, rows, unique):
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    prints = {i: plain_fingerprint(t) for i, t in unique.items()}
    want = plain_components(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    for r in found:
        if r["id"] is not None:
            assert r["fp"] & (1 << 64) - 1 == prints[r["id"]] and r["component_id"] == want[r["id"]]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(want.values()))
    assert simhash.near_duplicates(empty(docs)).count() == 0 and simhash.keep_one(empty(docs)).count() == 0


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
@pytest.mark.parametrize("long_list", [3, 1000])
def test_links_find_all_pairs_also_through_midpoints(spark, bits, long_list):
    rng = random.Random(bits)
    centres = [rng.getrandbits(64) for _ in range(4)]
    prints = {rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(50)}
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in prints)
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    linked = simhash.links(df, bits=bits, probe=3, long_list=long_list).collect()
    mask = (1 << 64) - 1
    assert all(((a ^ b) & mask).bit_count() <= bits for a, b in linked) or long_list == 3
    far = lambda a, b: ((a ^ b) & mask).bit_count() <= bits
    assert plain_components(signed, far) == plain_components(signed, lambda a, b: (a, b) in pairs or (b, a) in pairs) if (pairs := {tuple(r) for r in linked}) is not None else False


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.components(chain.union(spark.createDataFrame([(900, 901)], "a bigint, b bigint")))
    assert {(r["node"], r["component"]) for r in found.collect()} == {(i, 0) for i in range(201)} | {(900, 900), (901, 900)}


def plain_repeats(rows, length):
    seen, out = set(), []
    for i, t in rows:
        data = (t or "").encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        out.append((i, len(data), sum(gone), hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def test_repeats(spark, docs, rows):
    once = dict.fromkeys((i, t) for i, t in rows if i is not None)
    ordered = sorted(once, key=lambda r: r[0])
    df = spark.createDataFrame(ordered, "doc_id bigint, text string").repartition(4)
    for options in ({}, {"batch_bytes": 4000, "bucket_bytes": 3000}):
        found = repeats.remove_repeats(df, **options).collect()
        got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found)
        assert got == sorted(plain_repeats(ordered, 100))
        assert all(r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"]) for r in found)
    assert len(repeats.remove_repeats(docs).collect()) == len(rows) and repeats.remove_repeats(empty(docs)).count() == 0


def test_repeats_of_periodic_and_random_bytes(spark):
    rng = random.Random(9)
    out = []
    for i in range(30):
        t = "".join(rng.choice(["ab" * rng.randint(1, 120), "".join(rng.choice("abc") for _ in range(rng.randint(1, 160))), "é" * rng.randint(1, 90)]) for _ in range(rng.randint(0, 6)))
        out.append((i, t))
    out += [(100 + i, t[5:] + "tail") for i, t in out[:15]]
    found = repeats.remove_repeats(spark.createDataFrame(out, "doc_id bigint, text string").repartition(3), batch_bytes=700).collect()
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in found)
    assert got == sorted(plain_repeats(out, 100))


def test_token_shards(spark, docs, rows):
    path = new_dir(spark, "shards")
    sstable.write_tokens(docs, path, shard_bytes=4000)
    found = sstable.read_tokens(spark, path).orderBy("start").collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert [r["doc_id"] for r in found] == [i for i, _ in sorted(((i, t) for i, t in rows), key=key)]
    at, wanted = 0, {}
    for i, t in rows:
        wanted.setdefault(i, []).append(expected_ids(t or "", 2).tobytes())
    for r in found:
        assert r["start"] == at and r["n_tokens"] * 4 == len(r["ids"]) and bytes(r["ids"]) in wanted[r["doc_id"]]
        at += r["n_tokens"]
    files = [sstable.Shard(bytes(r["content"])) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*.txt").load(path).collect()]
    for i, values in wanted.items():
        got = sorted(v for f in files for v in f.get(sstable.encode_key(i)))
        assert sorted(sstable.decode_value(v).tobytes() for v in got) == sorted(values)
    assert not any(f.get(sstable.encode_key(10**9)) for f in files)
    asked = [None, 0, -9, 10**9, 21, 30]
    got = sorted((str(r["doc_id"]), bytes(r["ids"])) for r in sstable.lookup(spark, path, asked).collect())
    assert got == sorted((str(i), v) for i in asked for v in wanted.get(i, []))
    hot = spark.createDataFrame([(7, f"text number {i} " * 40) for i in range(60)] + [(6, "a"), (8, "b")], "doc_id bigint, text string").repartition(3)
    sstable.write_tokens(hot, path + "-hot", shard_bytes=8000)
    index = sstable.read_index(spark, path + "-hot").collect()
    assert sum(r["entries"] for r in index) == 62 and sum(r["entries"] > 0 for r in index) >= 3 and sstable.lookup(spark, path + "-hot", [7]).count() == 60
    sstable.write_tokens(empty(docs), path + "-empty")
    assert sstable.read_tokens(spark, path + "-empty").count() == 0


def test_shard_blocks_and_lookup():
    writer, sections = sstable.Writer(3, block_bytes=256), []
    keys = sorted(random.Random(2).sample(range(-(1 << 40), 1 << 40), 500))
    for k in keys:
        sections += writer.add(sstable.encode_key(k), sstable.encode_value(np.array([k % 70000, 5])), 2)
    sections += writer.close()
    shard = sstable.Shard(b"".join(s + b"\n" for s in sections))
    assert (shard.entries, shard.ids, shard.number) == (500, 1000, 3) and len(shard.blocks) > 10
    assert [sstable.decode_key(k) for k, _ in shard.scan()] == keys
    assert all(sstable.decode_value(shard.get(sstable.encode_key(k))[0]).tolist() == [k % 70000, 5] for k in keys)
    missing = [k for k in range(5000) if k not in keys]
    assert sum(shard.may_hold(sstable.encode_key(k)) for k in missing) < 0.03 * len(missing) and not any(shard.get(sstable.encode_key(k)) for k in missing)


def test_url_rules_and_model(spark):
    urls = ["https://A.Example.com/en/x?q#f", "http://www.example.com/en/1", "http://example.net/es/2", "ftp://net/fr/", "http://xnet/fr/", "http://com", "no url", None, "", "http://casino-win.example.org/en/3", "http://library.example.org/de/4"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    found = {r["page_id"]: r for r in url_filter.judge(pages).collect()}
    assert [found[i]["host"] for i in range(9)] == ["a.example.com", "www.example.com", "example.net", "net", "xnet", "com", "", "", ""]
    assert [found[i]["path"] for i in range(6)] == ["/en/x", "/en/1", "/es/2", "/fr/", "/fr/", ""]
    assert [(found[i]["rule"], found[i]["verdict"]) for i in range(4)] == [("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    assert found[4]["rule"] is None and found[5]["rule"] is None  # com without a path doesn't start with /
    assert found[9]["verdict"] == "block" and found[10]["verdict"] == "allow"
    assert url_filter.judge(pages.where("false")).count() == 0
    assert url_filter.train([]).scores(["x"], ["/y"])[0] == 0.5


def test_html_extraction(spark):
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><a href=/>Home</a></nav><div class='ad banner'>Buy <div>now</div></div>"
        "<article><h1>A  title&amp;</h1><p>First <b>bold\n text</b>.<br><p>Second &lt;one&gt; &eacute;<script>var x='</p>'</script></p><div class=comments><p>I like it</p></div><p>Last</p></article>"
        "<aside>More</aside><form><input name=q>Send</form><footer>&copy; me</footer></body></html>"
    )
    plain = "<div><a href=/>Home</a></div>" + "<p>" + "Long text of the page. " * 8 + "</p><p>" + "And more of it here. " * 8 + "</p>" + "<div><a href=/>one</a> <a href=/>two</a></div>" * 5
    rows = [(1, page), (2, None), (3, ""), (4, "<p>unclosed <b>text"), (5, plain), (6, "<!-- only -->"), (7, "<article></article><nav>x</nav>"), (8, page)]
    found = {r["page_id"]: r["text"] for r in html_extract.extract_pages(spark.createDataFrame([(i, h, "c") for i, h in rows], "page_id bigint, html string, text string")).collect()}
    assert found[1] == found[8] == "A title& First bold text. Second <one> é Last"
    assert (found[2], found[3], found[6], found[7]) == ("", "", "", "") and found[4] == "unclosed text"
    assert found[5].startswith("Long text") and found[5].endswith("it here.")
    assert html_extract.segments([0, 0, 3, 0, 2, 0, 0, 0, 5], 3) == [(2, 5), (8, 9)]


def test_language_id(spark):
    rng = random.Random(4)
    words = {"aa": ["bada", "gado", "dabi"], "bb": ["krel", "strel", "ekl"], "cc": ["слово", "дело"]}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 20)]
    rows += [(900, None, "aa"), (901, "text of none", None)]
    train = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(train)
    assert model.langs == ["aa", "bb", "cc"]
    mixed = " ".join(["bada gado"] * 20 + ["krel strel"] * 15)
    tests = spark.createDataFrame([(1, "gado dabi bada"), (2, "Strel EKL krelo"), (3, None), (4, ""), (5, "12 ½ !!"), (6, "дела"), (7, mixed), (7, mixed)], "doc_id bigint, text string").withColumn("lang_pred", F.lit("clash"))
    found = {r["doc_id"]: r for r in langid.identify(tests, model).collect()}
    assert [found[i]["lang_pred"] for i in range(1, 8)] == ["aa", "bb", "und", "und", "und", "cc", "aa"]
    assert found[3]["lang_score"] == 0 and 0.5 < found[7]["lang_score"] < 0.7
    cut = [(r["lang"], r["words"]) for r in langid.spans(tests.where("doc_id = 7").limit(1), model).orderBy("start").collect()]
    assert cut == [("aa", 40), ("bb", 30)]
    nothing = langid.train(train.where("false"))
    assert {r["lang_pred"] for r in langid.identify(tests, nothing).collect()} == {"und"} and langid.identify(tests.where("false"), model).count() == 0


def test_the_path_is_the_search_s():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, langs = rng.integers(1, 9), 3
        s = -rng.integers(0, 6, (n, langs)).astype(float)
        penalty = float(rng.integers(1, 8)) + 0.5
        def value(path):
            return sum(s[i, p] for i, p in enumerate(path)) - penalty * sum(a != b for a, b in zip(path, path[1:]))
        best = max(value(p) for p in np.ndindex(*[langs] * n)) if n < 7 else None
        model = langid.Model(["a", "b", "c"], {}, np.zeros((1, 3)), {}, np.zeros((1, 3)), {}, 3, 99, penalty)
        model.rows = lambda words, s=s: s
        got = value(model.spans(["w"] * n).tolist())
        assert got == value(langid.viterbi(s, penalty).tolist()) and (best is None or abs(got - best) < 1e-9)


def plain_distance(item, doc, most):
    row = [0] * (len(doc) + 1)
    for i, w in enumerate(item, 1):
        last, row = row, [i]
        for j, x in enumerate(doc, 1):
            row.append(min(last[j - 1] + (w != x), last[j] + 1, row[-1] + 1))
    return min(row)


def test_decontamination(spark, docs):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(12, 40)))) for k in range(20)] + [(50, "one two"), (51, ""), (52, None), (3, "w1 w2 w3 w4 w5 w6")]
    rows, truth = [], set()
    for d in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if d % 2:
            k, t = items[rng.randrange(20)]
            part = t.split()
            for _ in range(rng.randint(0, int(0.2 * len(part)))):
                p = rng.randrange(len(part))
                part[p : p + 1] = rng.choice([[], [part[p], rng.choice(vocabulary)], [rng.choice(vocabulary)]])
            words[len(words) // 2 : len(words) // 2] = [x.upper() + "," for x in part]
        rows.append((d, " ".join(words)))
    rows += [(500, "One, two!"), (501, "one two three"), (502, ""), (503, None), (504, items[2][1]), (504, items[2][1])]
    for d, t in rows:
        ws = decontaminate.words_of(t or "")
        for k, x in items:
            item = decontaminate.words_of(x or "")
            if item and plain_distance(item, ws, 0) <= int(0.2 * len(item)):
                truth.add((d, k))
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id bigint, text string, distance string").repartition(3)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for block in (1 << 20, 700):
        found = decontaminate.contaminated(df, bench, block_bytes=block).collect()
        got = {(r["doc_id"], r["item_id"]) for r in found}
        assert got <= truth and len(got) >= 0.97 * len(truth)
        assert sum(r["doc_id"] == 504 and r["item_id"] == 2 and r["distance"] == 0 for r in found) == 2
    clean = decontaminate.decontaminate(df, bench)
    assert clean.columns == df.columns and {r["doc_id"] for r in clean.collect()} == {d for d, _ in rows} - {d for d, _ in got}
    assert decontaminate.contaminated(empty(docs), bench).count() == 0 and decontaminate.decontaminate(docs, bench.where("false")).count() == docs.count()
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0
