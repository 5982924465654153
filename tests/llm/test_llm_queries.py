import hashlib
import math
from collections import Counter

import pytest
from parity import mismatch

import corpus_pipeline
from tickloom.llm import bpe, decontaminate, queries, toxicity


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, small, name):
    assert mismatch(spark, small, queries.QUERIES[name], queries.SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_covers_its_table(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() == spark.read.parquet(f"{small}/documents.parquet").count()


def test_pipeline_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] == sizes[2] > sizes[3] > 0 and sizes[3] >= sizes[4] == sizes[5]
    whole = {(r.doc_id, r.ids_sha256) for r in corpus_pipeline.run(spark, small).collect()}
    assert whole == {(r.doc_id, r.ids_sha256) for r in docs.collect()}


def test_stages_take_odd_rows_and_empty_tables(spark, small):
    """Nulls, empty and very long texts, repeated rows, null ids and further columns pass through every stage."""
    rows = [(1, "a plain text of six words", "en", "s", 1), (1, "a plain text of six words", "en", "s", 1), (2, None, None, None, None), (3, "", "b", "s", 2), (None, "no id but some words of text here", "c", "s", 3), (4, "word " * 30_000, "d", "s", 4), (5, "日本語 " * 50, "e", "s", 5)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, `_kept` string, `_line` string")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        empty = stage(spark, docs.limit(0), small)
        assert empty.count() == 0 and empty.columns == out.columns, name
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns
            # the empty texts are one group of copies, and nothing else here is toxic, repeated or leaked
            want = Counter(r[0] for r in rows) - (Counter([3]) if name == "SimHash near-dedup" else Counter())
            assert Counter(r.doc_id for r in out.collect()) == want, name
        else:
            assert {(r.doc_id, r.n_tokens > 0) for r in out.collect()} == {(r[0], bool(r[1])) for r in rows}


def sets_of(text):
    words = text.lower().split()
    return {tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))} if words else set()


def leaks(words, piece, rare):
    """Whether some window of two and a third times the piece passes the checks, at any offset."""
    size = len(piece)
    if size < 5:
        return any(words[a : a + size] == piece for a in range(len(words)))
    width = size + size // 3 + 2 * (size // 2)
    masks = {}
    for i, w in enumerate(piece):
        masks[w] = masks.get(w, 0) | 1 << i
    if len(set(words) & set(piece)) < 0.4 * len(set(piece)) * 0.5:
        return False
    for a in range(0, max(1, len(words) - width + 1)):
        window = words[a : a + width]
        share = decontaminate.lcs_length(masks, size, window) / size
        if share >= 0.6 or share >= 0.4 and len(rare & set(window)) >= 0.8 * len(rare):
            return True
    return False


def test_pipeline_against_brute_force(spark, small):
    library = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("public_tokenizers")
    frame = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{small}/labels.parquet"))
    score = model.scorer()
    docs = {r.doc_id: r.text for r in frame.collect() if score(r.text) < 0.5}
    assert 0.7 * frame.count() < len(docs) < frame.count()
    # lines
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for i in sorted(docs):
        for line in docs[i].split("\n"):
            first.setdefault(key(line), i)
    docs = {i: "\n".join(x for x in t.split("\n") if len(key(x)) < 10 or first[key(x)] == i) for i, t in docs.items()}
    # near-duplicates, all pairs
    sets, label = {i: sets_of(t) for i, t in docs.items()}, {i: i for i in docs}
    links = [(a, b) for a in docs for b in docs if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(30):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    kept = {i: t for i, t in docs.items() if label[i] == i}
    assert links and len(kept) < len(docs)
    # benchmark, every piece and window; rare terms by their documents
    words = {i: decontaminate.words_of(t) for i, t in kept.items()}
    counts = Counter(w for own in words.values() for w in set(own))
    items = {r.item_id: decontaminate.words_of(r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    pieces = [p for own in items.values() for p in decontaminate.pieces_of(own)]
    weight = lambda w: math.log((len(kept) + 2) / (counts[w] + 1))
    rare = [set(sorted(set(p), key=lambda w: (-weight(w), w))[:5]) for p in pieces]
    clean = {i: kept[i] for i, own in words.items() if not any(leaks(own, p, r) for p, r in zip(pieces, rare))}
    assert len(clean) < len(kept)
    # tokens
    ranks = bpe.ByteBpe.load(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN).ranks
    encoding = library.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = set()
    for i, text in clean.items():
        ids = encoding.encode_ordinary(text)
        want.add((i, len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, small).collect()} == want
