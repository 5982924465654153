import hashlib
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tickloom.llm import bpe, chat, common, decontaminate, line_dedup, quality, sentence_dedup, similar, simhash, suffix_dedup, toxicity, url_filter
from tickloom.llm.components import connected_components

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = tokenizers.path("byte_bpe_50k.tiktoken")
PROSE = "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. "

#: Nulls, empty and blank texts, ties, repeated rows, and columns whose names clash with operators' own.
ODD = [
    (1, PROSE * 3, "a", 1), (1, PROSE * 3, "a", 1), (2, None, None, None), (3, "", "b", 2), (None, PROSE * 2 + "end", "c", 3), (4, " \t\n\x0b\x0c\r \n\n", "d", 4),
    (5, "word", "e", 5), (6, "naïve Ünïcode 日本語 🙂 text\nnaïve Ünïcode 日本語 🙂 text\n", "f", 6), (7, "x" * 5000, "g", 7), (8, "ab " * 3000, "h", 8),
]
ODD_SCHEMA = "doc_id long, text string, kept string, n_words long"
EMPTY = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("kept", StringType()), StructField("n_words", LongType())])


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, toxic int")


def operators(spark):
    bench = spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (4, "tiny one")], "item_id long, text string")
    return {
        "simhash": simhash.near_duplicates,
        "toxicity": lambda d: toxicity.score_toxicity(d, no_labels(spark)),
        "quality": lambda d: quality.judge_quality(d),
        "decontaminate": lambda d: decontaminate.decontaminate(d, bench),
        "bpe": lambda d: bpe.encode_texts(d, RANKS, tokenizers.PATTERN),
        "sentences": sentence_dedup.deduplicate_sentences,
        "suffixes": suffix_dedup.deduplicate_substrings,
        "lines": line_dedup.deduplicate_lines,
        "drop lines": line_dedup.drop_repeated_lines,
    }


@pytest.mark.parametrize("name", ["simhash", "toxicity", "quality", "decontaminate", "bpe", "sentences", "suffixes", "lines", "drop lines"])
def test_odd_rows_and_empty_tables(spark, odd, name):
    f = operators(spark)[name]
    out = f(odd)
    rows = out.collect()
    assert len(rows) == len(ODD)
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    empty = f(spark.createDataFrame([], EMPTY))
    assert empty.count() == 0 and empty.columns == out.columns


#: As above, with lines shared between documents with and without ids, and columns named like the operators' own.
CROWDED = [*((i, t) for i, t, *_ in ODD), (9, "a line of its own\nnaïve Ünïcode 日本語 🙂 text"), (None, "naïve Ünïcode 日本語 🙂 text\nmine alone, mine"), (None, "naïve Ünïcode 日本語 🙂 text\nmine alone, mine"), (2**63 - 1, PROSE * 3 + "x"), (-5, "word")]
NAMES = ["kept", "n_words", "_kept", "__kept", "_line", "_line_doc", "_doc", "_drop", "_m", "_measures", "_match", "_text", "id", "doc", "nameless", "fp", "node", "label", "found", "verdict_"]


@pytest.fixture(scope="module")
def crowded(spark):
    rows = [(i, t, *([f"c{k}"] * len(NAMES))) for k, (i, t) in enumerate(CROWDED)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in NAMES))


def linked_reference(near):
    """Least id of each crowded row's group: rows are linked by ``near`` or by a common id."""
    group = list(range(len(CROWDED)))
    for _ in CROWDED:
        for a, (i, x) in enumerate(CROWDED):
            for b, (j, y) in enumerate(CROWDED):
                if i is not None and i == j or near(x or "", y or ""):
                    group[a] = group[b] = min(group[a], group[b])
    least = {g: min((i for k, (i, _) in enumerate(CROWDED) if group[k] == g and i is not None), default=None) for g in group}
    return [least[g] for g in group]


def jaccard(x, y):
    a, b = ({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for t in (x, y))
    return len(a & b) / len(a | b) if a | b else 1.0


def test_crowded_rows_near_duplicates(crowded):
    alike = lambda x, y: (fingerprint_reference(x) ^ fingerprint_reference(y)).bit_count() <= 2
    least = linked_reference(alike)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(crowded).collect())
    assert got == Counter((i, f"{fingerprint_reference(t):016x}", g) for (i, t), g in zip(CROWDED, least))
    for drop, groups in ((simhash.drop_near_duplicates, least), (similar.drop_similar, linked_reference(lambda x, y: jaccard(x, y) >= 0.8))):
        kept = drop(crowded)
        assert kept.columns == crowded.columns
        assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter(row for row, g in zip(CROWDED, groups) if row[0] == g)
        assert drop(crowded.limit(0)).count() == 0


def test_crowded_rows_lines(crowded):
    gone = {(9, CROWDED[10][1]): "a line of its own", (None, CROWDED[11][1]): "mine alone, mine"}
    kept = line_dedup.drop_repeated_lines(crowded)
    assert kept.columns == crowded.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, gone.get((i, t), t)) for i, t in CROWDED)
    got = Counter((r.doc_id, r.n_dropped, r.kept_text) for r in line_dedup.deduplicate_lines(crowded).collect())
    assert got == Counter((i, int((i, t) in gone), gone.get((i, t), t or "")) for i, t in CROWDED)


def test_crowded_rows_substrings_and_sentences(crowded):
    want = substring_reference([(t or "").encode() for _, t in CROWDED], 400)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.deduplicate_substrings(crowded).collect())
    assert got == Counter((i, *w) for (i, _), w in zip(CROWDED, want)) and sum(w[1] for w in want) > 5_000
    rows = sentence_dedup.deduplicate_sentences(crowded).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in CROWDED)
    lost = {(r.doc_id, r.n_removed > 0) for r in rows}
    assert {(2, False), (3, False), (4, False), (5, False), (6, False), (2**63 - 1, True)} <= lost and all(r.kept_text is None for r in rows if r.doc_id == 2)


def test_crowded_rows_rules_leaks_and_scores(spark, crowded):
    judged = quality.judge_quality(crowded)
    assert judged.count() == len(CROWDED) and set(NAMES) - {"kept", "n_words"} <= set(judged.columns)
    assert {r.n_words for r in judged.collect() if r.doc_id == 1} == {len(PROSE.split()) * 3}
    bench = spark.createDataFrame([(1, PROSE), (2, None), (3, ""), (4, "mine alone")], "item_id long, text string")
    holds = lambda t: [k for k, x in ((1, PROSE), (4, "mine alone")) if t and x.strip() in t]
    got = Counter((r.doc_id, tuple(r.item_ids)) for r in decontaminate.decontaminate(crowded, bench).collect())
    assert got == Counter((i, tuple(holds(t))) for i, t in CROWDED)
    clean = decontaminate.drop_contaminated(crowded, bench)
    assert clean.columns == crowded.columns and Counter((r.doc_id, r.text) for r in clean.collect()) == Counter(row for row in CROWDED if not holds(row[1]))
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(CROWDED)] + [(1, None), (77, 1)], "doc_id long, toxic int")
    scored = toxicity.score_toxicity(crowded, labels).collect()
    assert Counter(r.doc_id for r in scored) == Counter(i for i, _ in CROWDED) and len({r.score for r in scored if r.doc_id in (2, 3)}) == 1


@pytest.mark.parametrize("f", [simhash.near_duplicates, simhash.drop_near_duplicates, similar.drop_similar, line_dedup.deduplicate_lines, sentence_dedup.deduplicate_sentences, suffix_dedup.deduplicate_substrings])
def test_ids_that_are_no_integers_are_refused(spark, f):
    with pytest.raises(TypeError):
        f(spark.createDataFrame([("a", "text")], "doc_id string, text string"))


def test_clusters_need_a_shared_checkpoint_folder(monkeypatch):
    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: default)

    with pytest.raises(ValueError):
        common.checkpointed(type("Frame", (), {"sparkSession": Elsewhere})())


# ---- 1


def url_reference(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, h, p in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://org", "http://ORG/", "https://a.Example.ORG/en/12?x=/es/", "http://example.org/es/", "http://example.org/en/2#a", "http://notexample.org/es/", "x://org?/", "http://cheap-pills.net/a", "http://a.net/b://c.org/", "http://foo.net/x.org/y", "http://日本.org/ä", "http://" + "a" * 9000 + ".org/", "http://ex*mple.org/es/", "://org/x"]
    rules = [url_filter.UrlRule("allow", "org", "/"), url_filter.UrlRule("block", "example.org", "/es/"), url_filter.UrlRule("block", "example.org", "/en/1")]
    frame = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    got = {r.page_id: r for r in url_filter.filter_urls(frame, rules, [url_filter.UrlGlob("block", "*cheap-pills*")]).collect()}
    for i, u in enumerate(urls):
        host, path, best = url_reference(u)
        assert (got[i].host, got[i].path) == (host, path)
        assert got[i].rule == (best[0] if best else None)
        assert got[i].verdict == (best[1] if best else "block" if u and "cheap-pills" in u else "allow")
    assert url_filter.filter_urls(frame.limit(0), rules).count() == 0


def test_shift_and_against_regex():
    rng = random.Random(1)
    globs = ["".join(rng.choice("ab*?") for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    hit = url_filter.ShiftAnd(globs).matches(texts)
    assert url_filter.ShiftAnd(globs).words > 1
    for k, g in enumerate(globs):
        pattern = re.compile("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in g), re.S)
        assert [bool(pattern.fullmatch(t)) for t in texts] == hit[:, k].tolist()


# ---- 2


def fingerprint_reference(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts, out = [0] * 64, 0
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    for b in range(64):
        out |= (counts[b] * 2 > len(shingles)) << b
    return out


def components_reference(prints):
    ids, root = sorted(prints), {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_against_brute_force(documents, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    prints = {i: fingerprint_reference(t) for i, t in texts.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == components_reference(prints)


@pytest.mark.parametrize("limit", [20_000, 3])
def test_links_connect_all_close_fingerprints(spark, limit):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    prints = {p for b in base for p in [b, *(b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12))]}
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    nodes = frame.select(F.col("fp").alias("node"), F.col("fp").alias("label"))
    got = {r.node: r.label for r in connected_components(simhash.fingerprint_links(frame, cell_limit=limit), nodes).collect()}
    want = components_reference(dict(enumerate(sorted(prints))))
    order = sorted(prints)
    classes = defaultdict(set)
    for p in prints:
        classes[got[signed(p)]].add(p)
    expected = defaultdict(set)
    for i, r in want.items():
        expected[r].add(order[i])
    assert sorted(map(sorted, classes.values())) == sorted(map(sorted, expected.values()))


def test_manhattan_distance_bounds_hamming_distance():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2**63, (2, 500)).astype(np.uint64)
    v = np.abs(simhash.segment_counts(a).astype(int) - simhash.segment_counts(b)).sum(axis=1)
    u = np.bitwise_count(simhash.unary_codes(a) ^ simhash.unary_codes(b))
    assert (u == v).all() and (v <= np.bitwise_count(a ^ b)).all()


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)]
    nodes = [(i, i) for i in [*range(41), *range(100, 160), 500]]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame(nodes, "node long, label long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in range(100, 160)} == {100} and got[500] == 500


def test_components_scatter_the_links_of_hubs(spark):
    links = [(0, i) for i in range(1, 3_000)] + [(10_000, 10_000 + i) for i in range(1, 30)] + [(i, 20_000 + i) for i in range(0, 3_000, 7)]
    nodes = sorted({n for link in links for n in link})
    frame, labelled = spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(n, n) for n in nodes], "node long, label long")
    got = [{r.node: r.label for r in connected_components(frame, labelled, hub_links=limit).collect()} for limit in (50, 1_000_000)]
    assert got[0] == got[1] == {n: 10_000 if 10_000 <= n < 20_000 else 0 for n in nodes}
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(100)], "src long, dst long"), labelled, max_rounds=1)


def test_crowded_cells_of_a_fine_grid_are_bounded():
    rng = np.random.default_rng(4)
    fps = rng.integers(0, 2**63, 1).astype(np.uint64) ^ (np.uint64(1) << rng.integers(0, 64, (20_000, 4)).astype(np.uint64)).sum(axis=1, dtype=np.uint64)
    fps = np.unique(fps)
    sizes = [np.unique(cell, return_counts=True)[1].max() for cell in simhash._cells(simhash.segment_counts(fps, 1), simhash.FINE_SPARE, 2 + simhash.FINE_SPARE, 2)]
    assert max(sizes) <= 256 and len(sizes) == 120


def test_one_document_of_each_group_stays(documents, texts):
    want = components_reference({i: fingerprint_reference(t) for i, t in texts.items()})
    kept = simhash.drop_near_duplicates(documents)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values())) and kept.columns == documents.columns


def test_pipeline_near_duplicates_against_all_pairs(spark):
    rng = random.Random(21)
    prose = lambda n: [f"w{rng.randrange(5_000)}" for _ in range(n)]
    docs = {1_000: "", 1_001: " ", 1_002: "a b", 1_003: "A  b", 1_004: "a b c"}
    hub = prose(300)
    for k in range(400):
        words = docs[rng.randrange(k)].split() if k % 3 and k > 20 else prose(rng.randrange(20, 300))
        words = list(hub) if k % 8 == 0 else words
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = prose(1)[0]
        docs[k] = " ".join(words)
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in docs.items() for w in [t.lower().split()]}
    label, ids = {i: i for i in docs}, sorted(docs)
    links = [(a, b) for a in ids for b in ids if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    for _ in range(50):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    rows = [*docs.items(), (None, docs[1]), (None, "only here without an id"), (7, docs[7])]
    got = Counter(r.doc_id for r in similar.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert len(links) > 100
    source = spark.createDataFrame(rows, "id long, text string").withColumn("text", F.coalesce("text", F.lit("")).cast("binary"))
    for load in (similar.GROUP_SHINGLES, 500):  # whole components, and components in blocks
        marks, groups = similar.similar_groups(source, group_shingles=load)
        labels = {r.id: r.label for r in marks.join(groups, "node").where("id is not null").collect()}
        assert labels == label
    assert got == Counter([i for i in ids if label[i] == i] + [None] + [7] * (label[7] == 7))


def _sent_to_verification(monkeypatch, source, **options):
    sent, plain = [], similar._verify
    monkeypatch.setattr(similar, "_verify", lambda texts, *rest: sent.append(texts.count()) or plain(texts, *rest))
    marks, groups = similar.similar_groups(source, **options)
    return sum(sent), {r.id: r.label for r in marks.join(groups, "node").collect()}


def test_texts_that_share_a_phrase_do_not_chain_up(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for k in range(1_200):
        words = [f"w{rng.randrange(100_000)}" for _ in range(120 if k % 2 else 40)]
        for p in range(3):
            words[10 * p : 10 * p + 8] = [f"g{k // 8}p{p}x{j}" for j in range(8)]
        rows.append((k, " ".join(words).encode()))
    sent, labels = _sent_to_verification(monkeypatch, spark.createDataFrame(rows, "id long, text binary"))
    assert labels == {k: k for k, _ in rows}
    assert sent <= 40  # chance links brought hundreds of them


def test_a_large_group_of_near_texts_is_copied_a_few_times(spark, monkeypatch):
    rng = random.Random(6)
    hub = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(400):
        words = list(hub)
        for _ in range(3):
            words[rng.randrange(300)] = f"own{rng.randrange(10**6)}"
        rows.append((k, " ".join(words).encode()))
    sent, labels = _sent_to_verification(monkeypatch, spark.createDataFrame(rows, "id long, text binary"), group_shingles=6_000)
    assert set(labels.values()) == {0}
    assert sent <= 4 * len(rows)  # all pairs of its twenty blocks would take each text twenty times


# ---- 3


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    clean = ["river", "stone", "green", "house", "table", "music", "paper", "light"]
    rude = ["grumblek", "grumblex", "vilewort", "vileword", "snarkle"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(clean) for _ in range(30)]
        toxic = int(rng.random() < 0.2)
        if toxic:
            for _ in range(2):
                words[rng.randrange(30)] = rng.choice(rude)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    truth = dict(labels)
    got = toxicity.score_toxicity(docs, marks).collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_toxicity_on_held_out_documents(spark, small):
    folder = small.replace("sf0.001", "sf0.1")
    docs, marks = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, marks).where("held_out").join(marks.where("toxic is not null"), "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = ([r.score for r in scored if r.toxic == k] for k in (1, 0))
    assert len(toxic) > 5 and len(clean) > 50
    above = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / len(toxic) / len(clean)
    assert above > 0.95 and sum(r.predicted == r.toxic for r in scored) > 0.9 * len(scored)


def test_label_model_separates_classes_and_finds_copies():
    rng = np.random.default_rng(5)
    y = rng.random(4000) < 0.2
    votes = np.stack([np.where(y, rng.random(4000) < 0.7, rng.random(4000) < 0.05) for _ in range(6)], axis=1).astype(np.int8)
    votes = np.hstack((votes, votes[:, :1]))  # a voter that repeats the first
    posterior, table, correlation = toxicity.label_model(votes)
    assert ((posterior > 0.5) == y).mean() > 0.95 and abs(table[1, 1, 2] - 0.7) < 0.06 and correlation[0, 6] > 0.9


def test_toxicity_learns_from_every_labelled_row(spark):
    ids = spark.range(42_000).where(~toxicity.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id")
    late = [r.id for r in ids.collect()][30_000:]
    assert len(late) > 1_000
    rng, toxic = random.Random(8), set(late[::2])
    clean, rude = ["river", "stone", "green", "house", "table", "music"], ["grumblek", "vilewort", "snarkle", "mudwit", "oafling"]
    rows = [(k, " ".join(rng.choices(clean, k=8) + rng.sample(rude, 3 * (k in toxic))), int(k in toxic)) for k in range(42_000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    score = toxicity.fit(frame, frame).scorer()
    assert all(score(f"river {a} {b} house") > 0.5 > score("river house green") for a, b in zip(rude, rude[1:]))


def test_counted_rows_stand_for_repeated_rows():
    rng = np.random.default_rng(2)
    votes, counts = rng.integers(-1, 2, (40, 6)), rng.integers(1, 9, 40)
    hits = [np.flatnonzero(v == 1) for v in votes]
    target = rng.random(40)
    for got, want in zip(toxicity.label_model(votes, counts), toxicity.label_model(np.repeat(votes, counts, axis=0))):
        assert np.allclose(got if len(got) != 40 else np.repeat(got, counts), want)
    weights, bias = toxicity.train_linear(hits, 6, target, counts)
    plain, plain_bias = toxicity.train_linear([h for h, n in zip(hits, counts) for _ in range(n)], 6, np.repeat(target, counts))
    assert np.allclose(weights, plain) and np.isclose(bias, plain_bias)


# ---- 4


def quality_reference(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures_against_loops(documents, texts, odd):
    for frame, own in ((documents, texts), (odd, {r[0]: r[1] for r in ODD})):
        for r in quality.judge_quality(frame).collect():
            want = quality_reference(own[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r.base_failed and r.kept)


def test_quality_runs_no_python(documents):
    plan = quality.judge_quality(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# ---- 5


def test_leaks_are_found_and_clean_documents_left(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(80)
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    rng = random.Random(6)
    bench, hosts = items.collect(), [r for r in docs.collect()]
    words = {r.item_id: decontaminate.words_of(r.text) for r in bench}
    clean = [h for h in hosts if len(h.text) > 300 and not any(f" {' '.join(w)} " in f" {' '.join(decontaminate.words_of(h.text))} " for w in words.values())]
    planted, rows = {}, [(h.doc_id, h.text) for h in clean]
    for k in range(60):
        item, host = rng.choice(bench), rng.choice(clean).text.split()
        leak = item.text.split() if k % 2 else [w for w in item.text.split() if rng.random() > 0.15]
        at = rng.randint(0, len(host))
        planted[10_000 + k] = item.item_id
        rows.append((10_000 + k, " ".join(host[:at] + leak + host[at:])))
    got = {r.doc_id: r for r in decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    found = sum(item in got[d].item_ids for d, item in planted.items())
    assert found >= 0.9 * len(planted)
    assert sum(got[h.doc_id].contaminated for h in clean) <= 0.02 * len(clean)


def test_latent_space_is_fitted_on_every_passage(spark):
    rng = random.Random(12)
    items = [[f"t{rng.randrange(200)}" for _ in range(40)] for _ in range(30)]
    docs = [[rng.choice((f"t{rng.randrange(200)}", f"x{rng.randrange(50)}")) for _ in range(rng.randrange(90))] for _ in range(1_300)]
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string")
    pieces = [decontaminate.Piece(i, words) for i, words in enumerate(items)]
    terms = {w: k for k, w in enumerate(sorted({w for x in items for w in x}))}
    idf = np.log((len(docs) + 2) / (np.array([sum(w in d for d in map(set, docs)) for w in terms]) + 1))

    def unit(passages):
        a = np.array([[p.count(w) for w in terms] for p in passages]) * idf
        return (a := a[a.any(axis=1)]) / np.linalg.norm(a, axis=1, keepdims=True)

    corpus, own = unit([d[k : k + 40] for d in docs for k in range(0, len(d), 40)]), unit(items)
    gram = own.T @ own + decontaminate.CORPUS_SHARE * len(items) / len(corpus) * corpus.T @ corpus
    basis = np.linalg.qr(own.T @ own @ np.random.default_rng(7).standard_normal((len(terms), 10 + decontaminate.OVERSAMPLE)))[0]
    for _ in range(decontaminate.POWER_ROUNDS):
        basis = np.linalg.qr(gram @ basis)[0]
    values, turn = np.linalg.eigh(basis.T @ gram @ basis)
    basis = basis @ turn[:, np.argsort(-values)[:10]]
    vectors = own @ basis
    want = basis * idf[:, None] @ (vectors / (vectors**2).sum(axis=1, keepdims=True)).T
    (space,) = decontaminate.fit(frame, pieces, rank=10).spaces
    assert np.allclose(space.folded, want, atol=1e-4)


def test_fit_keeps_matrices_of_terms_off_the_driver(spark):
    items = [[f"t{k * 40 + j}" for j in range(40)] for k in range(90)]
    frame = spark.createDataFrame([(k, " ".join(items[k] + items[(k + 1) % 45])) for k in range(45)], "doc_id long, text string")
    tracemalloc.start()
    try:
        (space,) = decontaminate.fit(frame, [decontaminate.Piece(k, x) for k, x in enumerate(items)]).spaces
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert space.folded.shape == (3_600, 90) and np.isfinite(space.folded).all()
    assert peak < 3_600**2  # bytes: an eighth of a matrix of its terms


def test_texts_are_split_into_words_once_for_each_block(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(k, f"before {PROSE} after {k}" if k % 5 == 0 else f"other words {k}") for k in range(40)] + [(5, None), (None, PROSE), (7, "tiny one here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(counted, "doc_id long, text string")
    bench = spark.createDataFrame([(1, PROSE), (2, "tiny one")], "item_id long, text string")
    want = Counter((d, (1,) if text and PROSE in text else (2,) if text and "tiny" in text else ()) for d, text in rows)
    for size, blocks in ((decontaminate.PASS_PIECES, 1), (1, 2)):
        seen.value = 0
        found = decontaminate.decontaminate(frame, bench, pass_pieces=size)
        assert Counter((r.doc_id, tuple(r.item_ids)) for r in found.collect()) == want
        assert seen.value == len(rows), blocks


@pytest.mark.parametrize("n_items", [200, 2_000])
def test_leaks_of_large_benchmarks_against_checks_of_every_window(spark, n_items):
    rng = np.random.default_rng(n_items)
    prose = lambda n: [f"w{k}" for k in rng.zipf(1.3, n) % 20_000]
    items = [prose(rng.integers(30, 60)) for _ in range(n_items)]
    rows, planted = [(k, " ".join(prose(200))) for k in range(100)], {}
    for k in range(100):
        item, host = int(rng.integers(n_items)), prose(200)
        leak = items[item] if k % 2 else [w for w in items[item] if rng.random() > 0.15]
        at = int(rng.integers(200))
        planted[1_000 + k] = item
        rows.append((1_000 + k, " ".join(host[:at] + leak + host[at:])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    detectors = [decontaminate.fit(frame, pieces) for pieces in decontaminate.item_blocks(bench)]
    assert len(detectors) == 1 + (n_items > 1_000) and sum(len({p.item for p in d.pieces}) for d in detectors) == n_items
    of, home = defaultdict(list), {}
    for detector in detectors:
        for p in detector.pieces:
            of[p.item].append(p)
            home[p.item] = detector
    missed = {0: 0, 1: 0}
    for d, text in rows[100:]:
        words = decontaminate.words_of(text)
        if any(home[p.item]._verify(p, words[a : a + 93]) for p in of[planted[d]] for a in range(0, len(words), 13)):
            missed[d % 2] += planted[d] not in dict(home[planted[d]].find(text))
    assert missed[1] == 0 and missed[0] <= 2


def test_blocks_of_items_and_short_items(spark):
    rng = random.Random(23)
    prose = lambda n: [f"w{rng.randrange(3_000)}" for _ in range(n)]
    items = [(k, " ".join(prose(n))) for k, n in enumerate([30, 45, 3, 2, 35, 90, 1, 40])] + [(50, None), (51, " ... ")]
    rows = [(100 + k, " ".join(prose(60) + (text or "").split() + prose(60))) for k, text in items] + [(0, " ".join(prose(200))), (1, None), (2, "")]
    frame, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    words = {d: f" {text or ''} " for d, text in rows}
    for size in (decontaminate.PASS_PIECES, 3):
        got = {r.doc_id: r for r in decontaminate.decontaminate(frame, bench, pass_pieces=size).collect()}
        assert {d: r.item_ids for d, r in got.items()} == {d: [k for k, item in items if item and item != " ... " and f" {item} " in text] for d, text in words.items()}
        kept = decontaminate.drop_contaminated(frame, bench, pass_pieces=size)
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, r in got.items() if not r.contaminated)


def test_benchmarks_of_many_terms_keep_them_all(spark):
    items = [(k, " ".join(f"t{k * 40 + j}" for j in range(40))) for k in range(1_800)]  # 72,000 words
    frame = spark.createDataFrame([(k, f"some words before {text} and after") for k, text in items[::50]] + [(-1, "nothing of them")], "doc_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontaminate.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {-1: []} | {k: [k] for k, _ in items[::50]}


def test_words_are_those_of_the_pattern():
    chars = [c for c in map(chr, range(0x110000)) if not "\ud800" <= c <= "\udfff"]
    for step in (40, 1_000):  # few and many different characters between words
        for k in range(0, len(chars), step):
            text = "Aİ_".join(chars[k : k + step])
            assert decontaminate.words_of(text) == re.findall(r"\w+", text.lower())


def test_texts_sifted_together_give_what_each_gives(spark, small, monkeypatch):
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    pieces = next(decontaminate.item_blocks(bench))
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string")
    detector = decontaminate.fit(frame, pieces)
    texts = ["", *docs, "", *[f"{t[:200]} {r.text} {t[200:]}" for t, r in zip(docs, bench.collect())], ""]
    numbers = [decontaminate.numbers_of(t, detector.terms) for t in texts]
    alone = [detector.find_numbers(x) for x in numbers]
    assert sum(map(bool, alone)) > 30
    sifted, plain = [], detector._find_some
    monkeypatch.setattr(detector, "_find_some", lambda some: sifted.append(len(some)) or plain(some))
    assert detector.find_each(numbers) == alone and len(sifted) < len(texts) / 4
    monkeypatch.setattr(decontaminate, "TOGETHER_WORDS", 700)
    assert detector.find_each(numbers) == alone and detector.find_each([]) == []
    for found, x in zip(alone, numbers):  # the verifier on numbers is the one on words
        words = detector._words(x)
        for space in detector.spaces:
            own = space.local[x]
            for row, k in list(enumerate(space.members.tolist()))[:5]:
                assert detector._verify_numbers(space, row, own[:80]) == detector._verify(pieces[k], words[:80])


def test_common_subsequence_against_dynamic_programming():
    rng = random.Random(7)
    for _ in range(200):
        a, b = ([rng.choice("abcde") for _ in range(rng.randint(1, 30))] for _ in range(2))
        masks = {}
        for i, w in enumerate(a):
            masks[w] = masks.get(w, 0) | 1 << i
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.lcs_length(masks, len(a), b) == table[-1][-1]


# ---- 6


def test_bpe_against_the_library(spark, texts, odd):
    tiktoken = pytest.importorskip("tiktoken")
    model = bpe.ByteBpe.load(RANKS, tokenizers.PATTERN)
    assert bpe.ByteBpe.load(RANKS, tokenizers.PATTERN) is model
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=model.ranks, special_tokens={})
    rng = random.Random(8)
    alphabet = "aábcé \t\n\r\x0b\x1c\x85\u00a0\u2003\u3000'stredllm1٣½,.!日本🙂\u0301<|endoftext|>"
    samples = [*list(texts.values())[:60], *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(500)), "ab" * 4000, "", "<|endoftext|>"]
    for text, ids in zip(samples, model.encode(samples)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode_ordinary(text)
        assert model.decode(ids) == text.encode()
    encoded = bpe.encode_texts(odd, RANKS, tokenizers.PATTERN)
    for r in encoded.collect():
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, dtype="<u4").tobytes()).hexdigest()
    back = {(r.doc_id, r.decoded.decode()) for r in bpe.decode_ids(encoded, RANKS, tokenizers.PATTERN).collect()}
    assert back == {(r[0], r[1] or "") for r in ODD}


def test_lockstep_and_scalar_trees_agree():
    model = bpe.ByteBpe.load(RANKS, tokenizers.PATTERN)
    rng = random.Random(9)
    pieces = [bytes(rng.choice(b"etaoin shrdlu\xc3\xa9") for _ in range(rng.randint(1, 32))) for _ in range(400)]
    assert model.merge_rows(pieces, 32) == [model.merge_one(p) for p in pieces]


# ---- 7


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\l\\o\\b<s>", "", None, "a\nb", "[/INST]\\", "日本🙂<"]
    rng = random.Random(10)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "<s>odd[INST]"]), rng.choice(nasty), "x") for c in range(40) for t in range(rng.randint(1, 7))]
    rows += [(None, 0, "user", "q", "x"), (None, 1, "assistant", "r", "x"), (99, 0, "user", "same", "x"), (99, 0, "user", "same", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = chat.format_chats(frame)
    read = got.select("conv_id", "example", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"), "loss_length").collect()
    talks = defaultdict(list)
    for c, t, r, x, _ in rows:
        talks[c].append((t, r or "", x or ""))
    for c, turns in talks.items():
        turns.sort()
        own = sorted((r for r in read if r.conv_id == c), key=lambda r: r.example)
        replies = [k for k, t in enumerate(turns) if t[1] == "assistant"]
        assert [r.example for r in own] == replies + ([len(turns)] if turns[-1][1] != "assistant" else [])
        for r in own:
            upto = turns[: r.example + 1]
            assert [(t.role, t.text) for t in r.turns] == [t[1:] for t in upto]
            assert r.loss == (turns[r.example][2] if r.example < len(turns) else "")
    assert chat.format_chats(frame.limit(0)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- 8


def sentences_reference(text):
    """Keys of the sentences, told apart character by character."""
    sentences, now, ended = [], "", False
    for c in text:
        if ended and c not in ".!?" or c == "\n":
            sentences.append(now)
            now, ended = "", False
        if c != "\n":
            now, ended = now + c, c in ".!?"
    sentences.append(now)
    keys = []
    for sentence in sentences:
        words = re.findall(r"[^ .!?]+", sentence)
        if len(words) <= 25:
            keys.append(sentence)
            continue
        last, tail = 0, sentence[len(sentence.rstrip(".!?")) :]
        for k, w in enumerate(words):
            digest = hashlib.md5(f"{words[k - 1].lower() if k else ''} {w.lower()}".encode()).hexdigest()
            if digest[0] in "012" or k + 1 - last == 25 or k + 1 == len(words):
                keys.append(" ".join(words[last : k + 1]) + tail * (k + 1 == len(words)))
                last = k + 1
    return [k.strip(" ").lower() for k in keys if k.strip(" ")]


def test_sentence_spans_against_loops(spark):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(300)]
    sentence = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 12))) + rng.choice([".", "!", "?", "..."])
    shared = [" ".join(sentence() for _ in range(8)) for _ in range(5)]
    docs = [(i, rng.choice([" ", "\n"]).join(rng.choice([sentence(), sentence(), rng.choice(shared), rng.choice(shared).upper()]) for _ in range(12))) for i in range(60)]
    flat = [" ".join(rng.choice(vocabulary) for _ in range(150)) for _ in range(3)]  # without signs
    docs += [(60 + i, " ".join(rng.choice([sentence().rstrip(".!?"), rng.choice(flat)]) for _ in range(5))) for i in range(20)]
    seen, gone = {}, defaultdict(set)
    for i, text in docs:
        keys = sentences_reference(text)
        for a in range(len(keys)):
            for b in range(a + 3, len(keys) + 1):
                if sum(len(re.findall(r"[^ .!?]+", k)) for k in keys[a:b]) >= 20:
                    if seen.setdefault(tuple(keys[a:b]), (i, a)) != (i, a):
                        gone[i].update(range(a, b))
                    break
    for r in sentence_dedup.deduplicate_sentences(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        pieces, places, keys, _ = sentence_dedup.split_sentences(docs[r.doc_id][1].encode())
        out = {places[k] for k in gone[r.doc_id]}
        assert b"".join(pieces).decode() == docs[r.doc_id][1] and [k.decode() for k in keys] == sentences_reference(docs[r.doc_id][1])
        assert (r.n_sentences, r.n_removed) == (len(keys), len(gone[r.doc_id]))
        assert r.kept_text.encode() == b"".join(p for k, p in enumerate(pieces) if k not in out)


def test_passages_are_found_at_any_word_offset(spark):
    rng = random.Random(22)
    prose = lambda n: [f"w{rng.randrange(9_000)}" for _ in range(n)]
    for length, least in ((120, 0.6), (500, 0.85)):
        rows, passages = [], [prose(length) for _ in range(30)]
        for k, p in enumerate(passages):  # no sign ends a sentence, and each copy begins at another word of its line
            rows += [(2 * k, " ".join(prose(rng.randrange(60)) + p + prose(40))), (2 * k + 1, " ".join(prose(rng.randrange(60)) + p + prose(40)))]
        got = {r.doc_id: r for r in sentence_dedup.deduplicate_sentences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        lost = [len(rows[2 * k + 1][1].split()) - len(got[2 * k + 1].kept_text.split()) for k in range(30)]
        assert all(got[2 * k].n_removed == 0 for k in range(30))
        assert all(lost) and sum(lost) >= least * 30 * length and max(lost) <= length


@pytest.mark.parametrize("text", ["", "\n", " . ! ?", "a" * 5_000, "ab " * 3_000, "naïve Ünï\u00a0code 日本語。" * 40, "one two\x0bthree... four?!\n\n five " * 30])
def test_sentences_give_the_text_again(text):
    pieces, _, _, words = sentence_dedup.split_sentences(text.encode())
    assert b"".join(pieces) == text.encode() and max(words, default=0) <= 25


# ---- 9


def test_suffix_array_against_sorting():
    rng = random.Random(12)
    for _ in range(800):
        s = [rng.randint(0, rng.choice([1, 2, 4])) for _ in range(rng.randint(0, 40))]
        assert suffix_dedup.suffix_array(np.array(s, dtype=np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def substring_reference(docs, window):
    seen = Counter(t[i : i + window] for t in docs for i in range(len(t) - window + 1))
    out = []
    for t in docs:
        mark = np.zeros(len(t) + 1, dtype=int)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                mark[i] += 1
                mark[i + window] -= 1
        gone = np.cumsum(mark[:-1]) > 0
        out.append((len(t), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), bytes(np.frombuffer(t, dtype=np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("name_bytes", [1_000_000, 2_000, 1])
def test_substrings_against_brute_force(spark, name_bytes, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "COPY_ROWS", 50_000 if name_bytes > 2_000 else 1)
    rng = random.Random(13)
    base = ["".join(rng.choice("abcdé ") for _ in range(400)) for _ in range(6)] + ["ab" * 200, "the " * 90, "z" * 300]
    texts = []
    for _ in range(60):
        texts.append("".join((lambda b, i: b[i : i + rng.randint(0, 260)])(rng.choice(base), rng.randint(0, 200)) + rng.choice(["", "x", "yé"]) for _ in range(rng.randint(1, 5))))
    texts += [texts[0], texts[1], "", "short"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = substring_reference([t.encode() for t in texts], 64)
    for r in suffix_dedup.deduplicate_substrings(frame, window=64, name_bytes=name_bytes).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == want[r.doc_id]
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id][3]).hexdigest()


# ---- 10


def lines_reference(docs):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in docs:
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    out = {}
    for i, t in docs:
        lines = t.split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(stay), "\n".join(stay))
    return out


@pytest.mark.parametrize("size", [1 << 16, 1 << 17])
def test_lines_against_loops(spark, size):
    rng = random.Random(14)
    pool = ["Shared line number %d" % k for k in range(30)] + ["short", "ÄÖÜ ünïcode líne %", " \t padded shared line\r", "日本語のテキスト十文字以上です"]
    docs = [(i, "\n".join(rng.choice([rng.choice(pool), rng.choice(pool).upper(), f"unique {i} {rng.random()}"]) for _ in range(rng.randint(0, 15)))) for i in range(150)]
    want = lines_reference(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for r in line_dedup.deduplicate_lines(frame, filter_bytes=size).collect():
        assert (r.n_lines, r.n_dropped, r.kept_text) == want[r.doc_id]
    dropped = line_dedup.drop_repeated_lines(frame, filter_bytes=size)
    assert {r.doc_id: r.text for r in dropped.collect()} == {i: w[2] for i, w in want.items()}


def test_merged_filters_keep_every_repeated_line():
    rng = np.random.default_rng(15)
    keys = rng.integers(0, 2**63, 3000).astype(np.uint64)
    parts = [np.concatenate((keys[k::4], keys[:50] if k % 2 else keys[:0])) for k in range(4)]
    once = twice = np.zeros(1 << 16, dtype=bool)
    for part in parts:
        seen = line_dedup.TwiceSeen(1 << 13)
        seen.add(part)
        twice = twice | seen.twice | (once & seen.once)
        once = once | seen.once
    again = [k for k, n in Counter(np.concatenate(parts).tolist()).items() if n > 1]
    assert len(again) >= 50 and twice[line_dedup._bits(np.array(again, dtype=np.uint64), 1 << 13)].all()
