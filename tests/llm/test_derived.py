"""Resampling, SentencePiece and Merkle operators against plain Python, with nulls, empty and very long texts, repeated
rows, empty tables and extra columns whose names clash."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fluxfield.llm import decontamination, merkle, queries, resampling, sentence_pieces, sharding, token_files
from fluxfield.llm.common import new_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, id string, rank long, score string, block long, group string, ids string, pos int"
LONG = " ".join(f"Word{i % 911} ab" for i in range(60_000))
TEXTS = [
    "The first of many texts says little, but says it in many words, for all to read and to learn from it at last",
    None,
    "",
    " \n\t ",
    "Grüße aus München! ça va? 日本 語 don't ﬁx İstanbul ét́ \u0000 nul ▁ mark ▁▁ <s> </s> <unk> 🎉🎉",
    "   three spaces  and  two \n\n newlines\t tab   ",
    "x" * 30_000,
    LONG,
    "a b c " * 12,
    "The first of many texts says little, but says it in many words, for all to read and to learn from it at last",
]
LANGS = ["en", None, "de", "en", "", "fr", "é", "de", "en", "en"]
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def row(i, k=None):
    k = i % len(TEXTS) if k is None else k
    return (i, TEXTS[k], LANGS[k], None if k == 5 else f"s{k % 3}", None if k == 3 else 7 + k, 1, "x", 2, "y", 3, "g", "z", 0)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [row(i) for i in range(57)] + [row(3), row(3), row(None, 0), row(None, 0), row(None, 8)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_resample(rows, target, percent, least, ngrams, buckets, seed):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded(text))
        runs = [" ".join(words[i : i + n]) for n in range(1, ngrams + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    found = [(d, *features(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    drawn = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        drawn.setdefault(r, []).append(k + 1)
    return sorted(((*r, drawn[r].pop() if drawn.get(r) else None) for r in out), key=str)


@pytest.mark.parametrize("ngrams, percent, least, buckets", [(1, 10, 20, 10_000), (3, 55, 0, 70_000)])
def test_resampling(spark, docs, ngrams, percent, least, buckets):
    items = ["says little and learns a lot", None, "", "a b c"]
    target = spark.createDataFrame([(t, 1) for t in items], "text string, row int")
    found = resampling.resample(docs, target, percent=percent, least_words=least, ngrams=ngrams, buckets=buckets)
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], items, percent, least, ngrams, buckets, 2024)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want


def test_resampled_documents_are_whole_rows(spark, docs):
    target = spark.createDataFrame([("says little",)], "text string")
    found = resampling.resampled_documents(docs, target, percent=50, least_words=0)
    assert found.columns == docs.columns and found.count() == docs.count() // 2
    ranks = resampling.resample(docs, target, percent=50, least_words=0).where("rank is not null")
    assert Counter(r.doc_id for r in found.collect()) == Counter(r.doc_id for r in ranks.collect())


def test_resampling_of_nothing(spark, docs):
    target = spark.createDataFrame([("a",)], "text string")
    assert resampling.resample(docs.limit(0), target).count() == 0
    some = resampling.resample(docs, target.limit(0)).collect()
    assert len(some) == docs.count() and all(r.rank is None or r.rank > 0 for r in some)


def test_a_third_of_one_row_is_dealt_over_ranges(spark):
    """Rows of one score and id are no group of one task: their ranks are consecutive."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("a b c d").alias("text"))
    found = resampling.resample(rows, rows.limit(1).select("text"), percent=100, least_words=1)
    assert sorted(r["rank"] for r in found.collect()) == list(range(1, 3001))
    same = sorted(r["rank"] for r in found.where("doc_id = 7").collect())
    assert same == list(range(same[0], same[0] + 1001))


def library(texts):
    from sentencepiece import SentencePieceProcessor

    found = SentencePieceProcessor(model_file=MODEL)
    ids = [found.encode(t or "") for t in texts]
    return ids, [found.decode(x) for x in ids]


@pytest.mark.parametrize("block_chars, bucket_bytes", [(4096, 4096), (16 << 20, 50_000)])
def test_sentence_pieces_equal_the_library(docs, block_chars, bucket_bytes):
    rows = docs.select("doc_id", "text").collect()
    ids, texts = library([r.text for r in rows])
    want = sorted(((r.doc_id, i, t) for r, i, t in zip(rows, ids, texts, strict=True)), key=str)
    found = sentence_pieces.encode(docs, MODEL, block_chars, bucket_bytes)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted(((d, len(i), digest(",".join(map(str, i))), digest(t)) for d, i, t in want), key=str)
    assert sorted((tuple(r) for r in sentence_pieces.digests(found).collect()), key=str) == want


def test_chunks_equal_the_library_on_odd_texts(spark):
    draw = random.Random(5)
    parts = [" ", "  ", "   ", "▁", "\n", "\t", " ", "　", "a", "the", "Wort", "ing", "é", "日", "🎉", "́", "\x00", "<s>", "<0x0A>", "�", "0", "…", "zqx", "​"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(1, 14))) for _ in range(4000)]
    ids, decoded = library(texts)
    found = sentence_pieces.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), MODEL).orderBy("doc_id").collect()
    assert [r.ids for r in found] == ids and [r.decoded for r in found] == decoded


def test_only_marked_vocabularies_are_cut():
    model = sentence_pieces.Model(MODEL)
    assert model.in_chunks and model.chunks(" a  b ") == [" a", " b", ""] and model.chunks("") == []
    model.in_chunks = False
    assert model.chunks(" a b") == [" a b"] and model.encode([" a b"]) == [model.library.encode(" a b")]


def test_whole_texts_where_chunks_depend(spark, docs, monkeypatch):
    monkeypatch.setattr(sentence_pieces.Model, "_only_marks", lambda self: False)
    rows = docs.select("doc_id", "text").collect()
    ids, texts = library([r.text for r in rows])
    want = sorted(((r.doc_id, i, t) for r, i, t in zip(rows, ids, texts, strict=True)), key=str)
    assert sorted((tuple(r) for r in sentence_pieces.encode(docs, MODEL).collect()), key=str) == want


def test_decoding_of_given_ids_and_of_nothing(spark, docs):
    rows = spark.createDataFrame([(1, [264, 28705]), (2, []), (None, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in sentence_pieces.decode(rows, MODEL).collect()} == {1: library(["a "])[1][0], 2: "", None: ""}
    assert sentence_pieces.encode(docs.limit(0), MODEL).count() == 0


def hexdigest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(values):
    return hexdigest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels_of(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([hexdigest("".join(now[a : a + fanout])) for a in range(0, len(now), fanout)])
    return levels


def siblings(levels, k, fanout):
    """Lists of (left, right) from the leaf up."""
    out = []
    for now in levels[:-1]:
        a = k // fanout * fanout
        out.append(("".join(now[a:k]), "".join(now[k + 1 : a + fanout])))
        k //= fanout
    return out


def brute_manifest(rows, fanout, seventh):
    groups = {}
    for r in rows:
        claim = (*r[:3], r[3] + 1 if r[3] is not None and seventh(r[0]) else r[3], r[4])
        groups.setdefault(r[2], []).append((r[0], leaf_of(r), leaf_of(claim)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {g: levels_of([x[1] for x in groups[g]], fanout) for g in order}
    top = levels_of([trees[g][-1][0] for g in order], fanout)
    out = []
    for at, g in enumerate(order):
        for k, (d, leaf, claim) in enumerate(groups[g]):
            path = siblings(trees[g], k, fanout) + siblings(top, at, fanout)
            digest = claim
            for left, right in path:
                digest = hexdigest(left + digest + right)
            proof = hexdigest("".join(a + b for a, b in path))
            out.append((d, g, leaf, trees[g][-1][0], top[-1][0], proof, digest, digest == top[-1][0]))
    return sorted(out, key=str)


def seventh(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 0


@pytest.mark.parametrize("fanout, nodes", [(2, 4096), (2, 4), (5, 7)])
def test_manifest(spark, docs, monkeypatch, fanout, nodes):
    """Small blocks make many tiers of them, over groups as well."""
    monkeypatch.setattr(merkle, "BLOCK_NODES", nodes)
    more = docs.union(docs.where("doc_id < 9").withColumns({"lang": F.concat(F.lit("l"), "doc_id"), "doc_id": F.col("doc_id") + 100}))
    claimed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(more, claims={"n_chars": claimed}, fanout=fanout)
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in more.collect()]
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_manifest(rows, fanout, seventh)


def test_manifest_of_one_and_of_none(spark, docs):
    one = docs.where("doc_id = 4")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in one.collect()]
    assert [tuple(r) for r in merkle.manifest(one).collect()] == brute_manifest(rows, 2, lambda d: False)
    assert merkle.manifest(docs.limit(0)).count() == 0


def test_a_state_goes_on_from_its_slot():
    leaves = [hexdigest(str(k)) for k in range(7)]
    tree = merkle.Subtree(leaves, 2, 3)
    assert tree.fold(4, leaves[4]) == tree.root
    changed = [*leaves[:4], "0" * 64, *leaves[5:]]
    assert tree.fold(4, "0" * 64) == merkle.Subtree(changed, 2, 3).root != tree.root


def test_a_group_of_a_third_is_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_NODES", 64)
    rows = spark.range(2000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(3).cast("long").alias("n_chars"), F.lit("abc").alias("text"))
    want = brute_manifest([tuple(r) for r in rows.collect()], 2, lambda d: False)
    assert sorted((tuple(r) for r in merkle.manifest(rows).collect()), key=str) == want


def test_registered():
    assert {"op11_resampling", "op12_sentence_pieces", "op13_merkle_manifest"} <= set(queries.queries())


def test_sharding_keeps_small_groups_beside_a_heavy_text(spark):
    """A third of the rows are one text, the others groups of four: only the heavy one is in several shards."""
    n = 60_000
    text = F.when(F.col("id") % 3 == 0, "the one text of a third of all rows").otherwise(F.concat(F.lit("group "), F.expr("id div 6")))
    rows = sharding.shard_documents(spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"))).collect()
    shards, sizes = {}, Counter()
    for r in rows:
        shards.setdefault(r.text_crc32, set()).add(r.shard)
        sizes[r.shard] += r.size
    assert len(rows) == n and sum(len(s) > 1 for s in shards.values()) == 1
    assert max(sizes.values()) - min(sizes.values()) < 0.03 * sum(sizes.values()) / 8


def test_decontamination_of_many_equal_rows(spark):
    """A third of the rows are one contaminated document, a third one clean one: each comes back as often as it is there."""
    passage = "one two three four five six seven eight nine ten eleven"
    hot = spark.range(6000).select(
        F.when(F.col("id") % 3 == 2, F.col("id")).otherwise(F.col("id") % 3).alias("doc_id"), F.when(F.col("id") % 3 == 0, passage).when(F.col("id") % 3 == 1, "clean words").otherwise(F.concat(F.lit("word "), "id")).alias("text")
    )
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    found = decontamination.find_benchmark_windows(hot.repartition(7), bench)
    n = {r.doc_id: r["count"] for r in found.where("doc_id < 2").groupBy("doc_id", "n_hit", "n_words", "contaminated").count().collect()}
    assert found.count() == 6000 and n == {0: 2000, 1: 2000}
    assert found.where("contaminated").count() == 2000 and found.where("contaminated and (n_hit <> 11 or n_items <> 1)").isEmpty()
    assert decontamination.clean_documents(hot, bench).count() == 4000


def test_token_files_divide_one_id(spark, monkeypatch):
    """A third of the rows have one id, a third none: no file has more than twice the mean."""
    monkeypatch.setattr(token_files, "LEAST_BYTES", 20_000)
    doc_id = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id"))
    docs = spark.range(6000).select(doc_id.alias("doc_id"), F.concat(F.lit("some words of text "), F.col("id") % 40).alias("text"), F.lit(1).alias("hash"), F.lit(2).alias("row"))
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    folder = new_path(spark, "tokens")
    manifest = token_files.write_token_files(docs, vocabulary, folder)
    assert len(manifest) > 4 and max(m.n_docs for m in manifest) < 2 * 6000 / len(manifest)
    rows = sorted(token_files.read_token_files(spark, manifest, vocabulary, folder).collect(), key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert keys == sorted(keys) and len(rows) == 6000
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))][: len(rows)]
