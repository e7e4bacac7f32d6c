"""Native operators against plain Python, with nulls, empty and long texts, repeats, empty tables and extra columns."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from fluxfield.llm import chat_tools, decontamination, mixing, quality_rules, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, shard string, word string"
LONG = " ".join(f"w{i % 977}" for i in range(12_000))
TEXTS = [
    "a quick brown fox jumps over the lazy dog and runs far away from the big bad wolf tonight " * 3,
    "line one here\nline one here\n\n  \nother ### $$ line\nother ### $$ line",
    None,
    "",
    " \n\t ",
    "Grüße aus München, ça va? naïve café 日本 語 " * 9,
    LONG,
    "one two three four five six seven eight one two three four five six seven eight nine",
    "a quick brown fox jumps over the lazy dog and runs far away from the big bad wolf tonight " * 3,
    "x" * 5000,
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i == 4 else f"s{i % 3}", 7, "x", "y", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[0], (None, "no id", "en", "s1", 1, "x", "y", "z")], SCHEMA)


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    wins = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(wins)
    hit = {j for i, w in enumerate(wins) if n[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(hit)


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def buckets(words, size):
    one = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42)) for a, b in zip(one, one[1:])]
    return [signed(h) % size for h in one + two]


def test_quality_rules(spark, docs):
    trusted = spark.createDataFrame([(i,) for i in (0, 1, 5, 6, 6, 7, 99, None)], "doc_id long")
    rows = quality_rules.quality_rules(docs, trusted, buckets=512).collect()
    assert len(rows) == len(TEXTS) + 2
    fold = {i: signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)) % 5 == 0 for i in (0, 1, 5, 6, 7, 99)}
    pairs = [(d, t or "") for d, t in [(r.doc_id, r.text) for r in docs.collect()]]
    raw = Counter(b for _, t in pairs for b in buckets(WORD.findall(t), 512))
    good = Counter(b for d, t in pairs if d in fold and not fold[d] for b in buckets(WORD.findall(t), 512))
    share = lambda c, b: (c[b] + 0.5) / (sum(c.values()) + 256)
    weight = {b: round(1e6 * math.log(share(good, b) / share(raw, b))) for b in range(512)}
    texts = dict(pairs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base(texts[r.doc_id]), r.doc_id
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        grams = buckets(WORD.findall(texts[r.doc_id]), 512)
        assert r.llr == math.floor(sum(weight[b] for b in grams) / max(1, len(grams))) / 1e6
        assert r.kept == (not r.base_failed and r.llr >= r.threshold)
    assert quality_rules.quality_rules(docs.limit(0), trusted).count() == 0
    assert {(r.llr, r.threshold) for r in quality_rules.quality_rules(docs, trusted.limit(0)).collect()} == {(0.0, 0.0)}


def test_quality_threshold(spark):
    """The highest thousandth that at least the share of the calibration documents reach."""
    rows = [(i, " ".join(f"w{(i * k) % (7 + i % 5)}" for k in range(20 + i % 9))) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    trusted = [i for i in range(400) if i % 3]
    fold = {i for i in trusted if signed(xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42)) % 5 == 0}
    for share in (0.99, 0.7):
        found = quality_rules.quality_rules(table, table.where("doc_id % 3 <> 0").select("doc_id"), buckets=256, trusted_share=share).collect()
        scores = [round(1e6 * r.llr) for r in found if r.doc_id in fold]
        grid = {s // 1000 * 1000 for s in scores}
        assert {round(1e6 * r.threshold) for r in found} == {max(g for g in grid if sum(s >= g for s in scores) >= share * len(scores))} and len(scores) > 30


def test_sharding(spark, docs):
    many = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text each time").otherwise(F.concat(F.lit("text "), F.expr("repeat(cast(id as string), cast(id % 17 as int))"))).alias("text")
    )
    for df in (docs, many):
        rows = sharding.shard_documents(df).collect()
        text = {r.doc_id: r.text or "" for r in df.collect()}
        assert len(rows) == df.count() and all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
        for k in range(8):
            assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    sums = Counter()
    for r in rows:
        sums[r.shard] += r.size
    assert max(sums.values()) - min(sums.values()) < 0.05 * sum(sums.values()) / 8 and len(sums) == 8
    alone = Counter(r.text_crc32 for r in rows)
    assert all(len({r.shard for r in rows if r.text_crc32 == c}) == 1 for c, n in alone.items() if 1 < n < 100)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_sharding_splits_a_hot_text_without_ids(spark):
    """Half of the rows are one text, without ids or with one id for all; a third are empty."""
    hot = F.when(F.col("id") % 2 == 0, F.lit("one text " * 20)).when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("text "), "id"))
    for doc_id in (F.lit(None).cast("long"), F.lit(7).cast("long")):
        rows = sharding.shard_documents(spark.range(30_000).select(doc_id.alias("doc_id"), hot.alias("text"))).collect()
        size, slots = Counter(), {}
        for r in rows:
            size[r.shard] += r.size
            slots.setdefault(r.shard, []).append(r.slot)
        mean = sum(size.values()) / 8
        assert len(rows) == 30_000 and all(abs(size[k] - mean) < 0.05 * mean for k in range(8))
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mixing(spark, docs):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == docs.count()
    taken, target, size = Counter(), {}, {}
    for r in rows:
        taken[r.source] += r.taken
        target[r.source], size[r.source] = r.target, r.source_size
        assert 0 <= r.taken <= 3 * r.size
    assert all(abs(taken[s] - target[s]) <= 1 and target[s] <= 3 * size[s] for s in target)
    assert abs(sum(target.values()) - sum(size.values())) < 1e-6 * sum(size.values())
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_sources(docs).collect()), key=repr)
    # The targets: shares by weight, what is above three times a source's size shared again until none is.
    names = sorted(size, key=lambda s: (s is None, s or ""))
    want, open_, left = {}, dict(zip(names, [1, 2, 3, 1], strict=False)), float(sum(size.values()))
    while True:
        over = [s for s in open_ if left * open_[s] / sum(open_.values()) > 3 * size[s]]
        if not over:
            want |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
            break
        for s in over:
            want[s] = 3.0 * size[s]
            left -= want[s]
            del open_[s]
    assert all(math.isclose(want[s], target[s], abs_tol=1e-6) for s in names)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mixed_documents_with_null_and_repeated_ids(spark, docs):
    """Each row gets the words that mix_sources takes of it, wherever the cut falls."""
    body = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    rows = [(k, body(f"p{k}_", 5 + k % 7), "a", k) for k in range(30)] + [(None, body(f"n{k}_", 3 + k), "a", k) for k in range(40)]
    rows += [(None, body("same", 9), "b", k) for k in range(40)] + [(7, body(f"r{k}_", 4 + k % 3), "b", k) for k in range(20)]
    rows += [(1000 + k, body("c", 40), "c", k) for k in range(20)] + [(7, body(f"z{k}_", 6), None, k) for k in range(12)] + [(None, None, "a", 0)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    for df in (docs, table):
        for seed in ("mix-0", "1", "2"):
            want, got = Counter(), Counter()
            for r in mixing.mix_sources(df, seed=seed).collect():
                want[r.doc_id, r.source] += r.taken
            for r in mixing.mixed_documents(df, seed=seed).collect():
                got[r.doc_id, r.source] += len(WORD.findall(r.text))
                assert r.n_chars == len(r.text)
            assert got == Counter({k: v for k, v in want.items() if v})
    # The mix of a source has its budget to the word, though null and repeated ids fill most of it.
    budget = {r.source: math.floor(r.target + 0.5) for r in mixing.mix_sources(table).collect()}
    words = Counter()
    for r in mixing.mixed_documents(table).collect():
        words[r.source] += len(WORD.findall(r.text))
    assert words == Counter(budget)
    # No more than one row of a source is cut, so all other texts are whole.
    texts, cut = {r[1] for r in rows}, Counter()
    for r in mixing.mixed_documents(table).collect():
        cut[r.source] += r.text not in texts
    assert max(cut.values()) <= 1


ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def item_words(text):
    return ITEM_WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def test_decontamination(spark, docs):
    passage = "The quick, BROWN fox jumps over the lazy dog and runs far away home"
    items = [(1, passage), (2, "short item here"), (3, None), (4, "!!!"), (10, "Über naïve café"), (11, passage), (12, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (None, "one two three four five six seven eight one two")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    more = spark.createDataFrame(
        [(100, f"noise {passage} noise {passage.upper()}!", *["x"] * 6), (101, "a Short item, here we go short item", *["x"] * 6), (102, "ÜBER naïve café", *["x"] * 6), (103, "über Über naïve  café", *["x"] * 6), (104, "quick brown fox jumps over the lazy dog and", *["x"] * 6)],
        "doc_id long, text string, lang string, source string, n_chars string, size string, shard string, word string",
    ).withColumn("n_chars", F.lit(1).cast("long"))
    table = docs.unionByName(more)
    rows = decontamination.find_benchmark_windows(table, bench).collect()
    wins = {}
    for i, t in items:
        w = item_words(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[k : k + 10]), set()).add(i)
    seen = Counter()
    for r in table.select("doc_id", "text").collect():
        w, hit, found = item_words(r.text), set(), set()
        for g, ids in wins.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    found |= ids
        names = sorted(str(i) for i in found if i is not None)
        seen[(r.doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))] += 1
    assert seen == Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in rows)
    clean = decontamination.clean_documents(table, bench)
    bad = {r.doc_id for r in rows if r.contaminated}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in rows} - bad and {100, 101, 103} <= bad and 104 not in bad
    assert decontamination.find_benchmark_windows(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontamination.find_benchmark_windows(docs, bench.limit(0)).collect())


def test_clean_documents_judges_rows_not_ids(spark):
    passage = "this passage of the benchmark has more than ten words to be found"
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    clean = [(None, "clean without an id"), (None, None), (1, "clean with a repeated id"), (1, "clean with a repeated id"), (2, "clean alone")]
    bad = [(None, f"noise {passage}"), (1, f"{passage} noise"), (1, f"{passage} noise"), (3, passage)]
    table = spark.createDataFrame(clean + bad, "doc_id long, text string")
    left = decontamination.clean_documents(table, bench)
    assert left.columns == table.columns and Counter(map(tuple, left.collect())) == Counter(clean)


def test_chat_tools(spark):
    calls = [
        ("c1", "a", 0, "f", '{"y":1,"x":"é\\"q"}', None),
        ("c1", "b", 1, "f", '{"x":5}', ["a", "a", "gone"]),
        ("c1", "c", 1, "g", "{}", ["a", "b"]),
        ("c1", "d", 2, "f", "not json", ["c"]),
        ("c1", "e", 3, "f", None, ["d", "b"]),
        ("c1", "a", 7, "later", "{}", None),
        ("c2", "p", 0, "f", '{"x":"1","z":2}', ["q"]),
        ("c2", "q", 1, "f", '{"x":"1"}', ["p"]),
        ("c2", "r", 1, "f", '{"x":"1"}', ["q"]),
        (None, "n", 1, "f", "{}", None),
    ] + [("long", f"k{i:03d}", i, "f", '{"x":"1"}', [f"k{i - 1:03d}"]) for i in range(90)]
    schema = "conv_id string, call_id string, turn int, name string, arguments string, depends_on array<string>"
    results = spark.createDataFrame([("c1", "a", 1, "r1"), ("c1", "a", 2, "r2"), ("c1", "zz", 2, None), (None, "a", 1, "x")], "conv_id string, call_id string, turn int, content string")
    fields = spark.createDataFrame([("f", "x", "STRING", True), ("f", "y", "BIGINT", False)], chat_tools.SCHEMA_COLUMNS)
    rows = {(r.conv_id, r.call_id): r for r in chat_tools.link_tool_calls(spark.createDataFrame(calls, schema), results, fields).collect()}
    one = lambda k: rows["c1", k]
    assert [(one(k).level, one(k).seq) for k in "abcde"] == [(0, 0), (1, 1), (2, 2), (3, 3), (4, 4)]
    assert [one(k).errors for k in "abcde"] == ["", "type of x", "unknown name", "not an object", "not an object"]
    assert one("a").n_results == 2 and one("a").valid and one("a").json == '{"arguments":{"x":"é\\"q","y":1},"id":"a","name":"f","result":"r1","status":"ok"}'
    assert one("zz").status == "orphan" and one("zz").seq is None and one("b").status == "no_result"
    assert {rows["c2", k].status for k in "pqr"} == {"cycle"} and rows["c2", "p"].errors == "unknown z"
    assert [rows["long", f"k{i:03d}"].level for i in range(90)] == list(range(90)) and len(rows) == 6 + 3 + 90
    empty = spark.createDataFrame([], schema)
    assert chat_tools.link_tool_calls(empty, results.limit(0), fields.limit(0)).count() == 0


def test_mixing_with_one_id_for_all(spark):
    """Every row of a source is alike to the mix, so the cut falls among them by row."""
    rows = spark.range(9_000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").otherwise("small").alias("source"), F.lit("a b c d e").alias("text")).repartition(7)
    taken, mixed = mixing.mix_sources(rows).collect(), Counter()
    target = {r.source: r.target for r in taken}
    for r in mixing.mixed_documents(rows).collect():
        mixed[r.source] += len(r.text.split())
    for s in ("big", "small"):
        own = [r.taken for r in taken if r.source == s]
        assert sum(own) == mixed[s] == math.floor(target[s] + 0.5) and max(own) - min(own) <= 5


#: Names that the operators use for columns of their own.
NAMES = ["doc", "id", "row", "hash", "print", "best", "source_size", "random_key", "size", "copy", "cut", "part", "extra", "epochs", "bad", "bad_hash", "_source", "_key", "_dropped", "_bad", "_text_hash", "_id", "words", "key", "range"]


def test_filtering_stages_keep_extra_columns(spark):
    from fluxfield.llm import simhash, toxicity

    passage = "this passage of the benchmark has more than ten words to be found"
    texts = ["a b c d e f g", "a b c d e f g", None, "", f"x {passage} y", "z " * 3000]
    rows = [(i if i % 3 else None, t, "en", "s", 1, *[f"{i}-{n}" for n in NAMES]) for i, t in enumerate([*texts, *texts])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    none = toxicity.Model([], [], 0.0, 0)
    outs = {
        "toxic": toxicity.drop_toxic(docs, none),
        "near": simhash.drop_near_duplicates(docs),
        "clean": decontamination.clean_documents(docs, bench),
        "mixed": mixing.mixed_documents(docs),
    }
    whole = set(rows)
    for name, out in outs.items():
        assert out.columns == docs.columns, name
        for r in out.collect():
            assert name == "mixed" or tuple(r) in whole
            assert len({x.split("-")[0] for x in r[5:]}) == 1 and [x.split("-")[1] for x in r[5:]] == NAMES
    assert outs["toxic"].count() == 12 and outs["clean"].count() == 10 and outs["near"].count() == 4
    for out in (sharding.shard_documents(docs), mixing.mix_sources(docs), decontamination.find_benchmark_windows(docs, bench), quality_rules.quality_rules(docs, bench.select(F.col("item_id").alias("doc_id")))):
        assert out.count() == 12


def test_chat_tools_types_and_depth(spark):
    fields = spark.createDataFrame(
        [("f", "x", "DOUBLE", True), ("f", "o.a", "BIGINT", True), ("f", "o.b.c", "STRING", False), ("f", "o", "OBJECT", False), ("f", "l", "ARRAY", False), ("f", "m", "ARRAY<BIGINT>", False)], chat_tools.SCHEMA_COLUMNS
    )
    cases = {
        "a": ('{"x":1.5,"o":{"a":1}}', ""),
        "b": ('{"x":2,"o":{"a":12345678901234567890,"b":{"c":"t"}},"l":["q"],"m":[1]}', ""),
        "c": ('{"x":1e3,"o":{"a":1.5}}', "type of o.a"),
        "d": ('{"x":"1","o":{"b":{"c":3}}}', "missing o.a; type of o.b.c; type of x"),
        "e": ('{"x":null,"o":[],"z":1}', "missing o.a; type of o; type of x; unknown z"),
        "f": ('{"x":1,"o":{"a":1},"l":{},"m":["s"]}', "type of l; type of m"),
        "g": ('{"x":1,"o":{"a":1},"l":["' + "long " * 50_000 + '"]}', ""),
    }
    rows = [("c", k, i if k != "g" else None, "f", j, None, "other") for i, (k, (j, _)) in enumerate(cases.items())]
    # Calls with several needs, forty after one another, and one that all need.
    rows += [("deep", f"k{i:02d}", i, "f", cases["a"][0], [f"k{j:02d}" for j in {0, i - 2, i - 1} if 0 <= j < i], "other") for i in range(40)]
    calls = spark.createDataFrame(rows, "conv_id string, call_id string, turn int, name string, arguments string, depends_on array<string>, status string")
    results = spark.createDataFrame([("c", "a", 1, None, "x")], "conv_id string, call_id string, turn int, content string, json string")
    found = {(r.conv_id, r.call_id): r for r in chat_tools.link_tool_calls(calls, results, fields).collect()}
    assert {k: found["c", k].errors for k in cases} == {k: want for k, (_, want) in cases.items()}
    assert found["c", "g"].seq == 0 and found["c", "a"].status == "ok" and len(found["c", "g"].json) > 250_000
    assert [found["deep", f"k{i:02d}"].level for i in range(40)] == list(range(40))


def test_levels_of_calls_with_several_needs_in_a_row(spark, monkeypatch):
    """A ladder of calls that each need the two before, beside calls that wait for its end: every round writes new rows
    only, so the parts of all rounds hold each call once."""
    from fluxfield.llm import chat_tools

    rows = [("c", str(k), [str(j) for j in (k - 1, k - 2) if j >= 0]) for k in range(14)]
    rows += [("c", f"w{k}", ["0", "13", "gone"]) for k in range(4)] + [("c", "x", ["y", "0"]), ("c", "y", ["x", "1"]), ("d", "0", [])]
    calls = spark.createDataFrame(rows, "conv_id string, call_id string, depends_on array<string>")
    tables, rounds = [], chat_tools.Rounds
    monkeypatch.setattr(chat_tools, "Rounds", lambda spark, name: tables.append((name, rounds(spark, name))) or tables[-1][1])
    got = {(r.conv_id, r.call_id): r.level for r in chat_tools.call_levels(calls).collect()}
    assert got == {("c", str(k)): k for k in range(14)} | {("c", f"w{k}"): 14 for k in range(4)} | {("d", "0"): 0}
    written = dict(tables[:1])["levels"].all().groupBy("conv_id", "call_id").count()
    assert written.where("`count` > 1").isEmpty()
    # What was met is written again only when over half of the rest is done.
    met = [t.all().count() for name, t in tables if name == "met"]
    assert len(met) > 1 and sum(met) <= 3 * (2 * 14 + 2 * 4 + 4)
