"""Operators on small fixtures: brute force, round trips, and the defined cases of dirty input."""

import base64
import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import chats, encodings, groups, languages, mixing, neardups, neighbours, pieces, tokens
from loomgraph.session import table

SF_DIR = "/root/testdata/sf0.001"


# --- groups -------------------------------------------------------------------------------


def brute_groups(edges):
    near = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out = {}
    for v in sorted(near):
        if v not in out:
            todo = [v]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = v
                    todo += near[x]
    return out


@pytest.mark.parametrize("cell", [200_000, 4])
def test_components_match_brute_force(spark, cell):
    rng = random.Random(3)
    edges = [(f"v{i:03d}", f"v{i + 1:03d}") for i in range(40)]  # a chain
    edges += [("hub", f"leaf{i}") for i in range(60)] + [(f"é{rng.randrange(30)}", f"z{rng.randrange(30)}") for _ in range(25)]
    edges += [("x", "x"), (None, "q"), ("q", None), ("v001", "v000"), ("v000", "v001")]
    df = spark.createDataFrame(edges, "a string, b string").withColumn("group_id", F.lit("clash"))
    got = {r.id: r.group_id for r in groups.connected_components(df, cell_edges=cell).collect()}
    assert got == brute_groups(edges)


def test_components_of_nothing(spark):
    assert groups.connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_entity_groups_dirt(spark):
    e = "id string, universe_id string, type string, name string, aliases array<string>, a string"
    rows = [
        ("e1", "u", "t", " Big  House", None, ""), ("e2", "u", "t", "other", ["BIG house", None, " "], ""), ("e3", "w", "t", "big house", [], ""),
        ("e4", None, "t", "big house", None, ""), ("e5", "u", "t", None, None, ""), ("e6", "u", "t", "", [""], ""), ("e1", "u", "t", "x" * 50_000, ["again"], ""), (None, "u", "t", "again", None, ""),
    ]
    m = "left_id string, right_id string, is_match boolean"
    pairs = [("e5", "e6", True), ("e5", "e3", False), ("e5", "e3", None), ("e5", "gone", True), (None, "e3", True), ("e3", "e3", True), ("e6", "e5", True)]
    got = groups.entity_groups(spark.createDataFrame(rows, e), spark.createDataFrame(pairs, m)).collect()
    assert {(r.group_id, r.entity_id) for r in got} == {("e1", "e1"), ("e1", "e2"), ("e5", "e5"), ("e5", "e6")} and len(got) == 4


# --- pieces -------------------------------------------------------------------------------


def brute_pieces(t, size=3500, overlap=300):
    out, p = [], 0
    while len(t) - p > size:
        window = range(p + size, p + size // 2, -1)
        tests = [lambda e: t[e - 2 : e] == "\n\n", lambda e: t[e - 1] == "\n", lambda e: t[e - 1] == "。" or (t[e - 1] == " " and t[e - 2] in ".!?"), lambda e: t[e - 1] == " "]
        e = next((e for ok in tests for e in window if ok(e)), p + size)
        out.append((p, e))
        p = e - overlap
    return [*out, (p, len(t))]


def noise(n, seed):
    rng = random.Random(seed)
    return "".join(rng.choice(["a", "b", "word", " ", ". ", "!", "? ", "\n", "\n\n", "\r\n", "\r", "。", "😀"]) * rng.choice([1, 1, 1, 40]) for _ in range(n))


def test_pieces_ranges_equal_brute_force(spark):
    texts = [noise(3_000, i) for i in range(4)] + ["x" * 20_000, "ab " * 5_000, "short", "", None, "y" * 3_500, "z\r\n" * 1_750, "z\r\n" * 1_751]
    rows = [(f"c{i}", t, None if i % 2 else i * 10, ["h"], "clash") for i, t in enumerate(texts)] * 2
    df = spark.createDataFrame(rows, "id string, text string, start_offset long, heading array<string>, piece_no string")
    want = set()
    for k, t, o, _, _ in rows:
        u = pieces.unify_newlines(t or "")
        if len(u) > 3500:
            want |= {(k, n, a + (o or 0), b + (o or 0)) for n, (a, b) in enumerate(brute_pieces(u))}
    for size in (1 << 20, 4_000):  # one range, and many that have to be stitched
        got = pieces.split_texts(df, range_chars=size).collect()
        assert {tuple(r)[:4] for r in got} == want and len(got) == len(want)
    assert pieces.split_texts(df.limit(0)).count() == 0


def test_giant_files_are_cut_without_loading_them(spark, tmp_path):
    text = noise(30_000, 9)
    (tmp_path / "big.txt").write_bytes(text.encode())
    (tmp_path / "small.txt").write_bytes("tiny é".encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    got = pieces.split_files(spark, [str(tmp_path / n) for n in ("big.txt", "small.txt", "empty.txt")], range_bytes=30_000).collect()
    big = sorted((r.piece_no, r.piece_start, r.piece_end) for r in got if r.path.endswith("big.txt"))
    assert big == [(n, a, b) for n, (a, b) in enumerate(brute_pieces(pieces.unify_newlines(text)))]
    assert [(r.piece_no, r.piece_start, r.piece_end) for r in got if r.path.endswith("small.txt")] == [(0, 0, 6)]


# --- neighbours ---------------------------------------------------------------------------


def clustered(n, seed=1, dim=64):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(n // 8, dim))
    return (centre[rng.integers(0, len(centre), n)] + 0.25 * rng.normal(size=(n, dim))).astype(np.float32)


def recall(x, found, k=5):
    s = neighbours.unit(x) @ neighbours.unit(x).T
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i, row in enumerate(np.argsort(-s, axis=1)[:, :k]) for j in row}
    return len(want & found) / len(want)


def test_graph_of_a_shard_recall():
    x = clustered(3_000)
    ids = np.array([f"v{i:04d}" for i in range(len(x))], dtype=object)
    a, b, s = neighbours.Shard(ids, x).nearest(5, -1.0)
    assert recall(neighbours.unit(x), set(zip(a.tolist(), b.tolist()))) >= 0.95 and len(a) == 5 * len(x)
    few = neighbours.Shard(ids[:40], x[:40]).nearest(5, -1.0)
    assert recall(neighbours.unit(x[:40]), set(zip(few[0].tolist(), few[1].tolist()))) == 1.0


def test_copies_are_folded_and_rank_by_id():
    x = clustered(200)
    many = np.concatenate([np.repeat(x[:1], 5_000, axis=0), x[1:]])
    ids = np.array([f"c{i:05d}" for i in range(len(many))], dtype=object)
    shard = neighbours.Shard(ids, many)
    assert len(shard.graph.x) == 200
    a, b, s = shard.nearest(5, -1.0)
    assert [int(y) for y in b[a == 3]] == [0, 1, 2, 4, 5] and [int(y) for y in b[a == 4_000]] == [0, 1, 2, 3, 4] and np.allclose(s[a == 3], 1)
    assert np.bincount(a, minlength=len(ids)).min() == 5
    a, b, s = shard.visited(ids[2:5], many[2:5], 5, -1.0)
    assert [int(y) for y in b[a == 1]] == [0, 1, 2, 4, 5]


@pytest.mark.parametrize("shard, cells", [(400, 8), (46, 66)])
def test_cells_shards_and_visitors_recall(spark, shard, cells, monkeypatch):
    monkeypatch.setattr(neighbours, "VISITORS", 150)
    x = clustered(1_500)
    rows = [(f"v{i:04d}", "u", "chunk", 1, x[i].tolist()) for i in range(len(x))] + [(f"w{i}", "w", "chunk", 1, x[i].tolist()) for i in range(3)]
    df = spark.createDataFrame(rows, "id string, universe_id string, kind string, created_at long, vector array<float>")
    assert -(-2 * 1_500 // shard) == cells
    got = [r for r in neighbours.nearest_records(df, shard=shard).collect() if r.id[0] == "v"]
    assert recall(x, {(int(r.id[1:]), int(r.other_id[1:])) for r in got}) >= 0.9 and len(got) == 5 * len(x)


def test_recall_without_clear_clusters(spark):
    centres = np.random.default_rng(3).normal(size=(40, 64))
    rng = np.random.default_rng(4)
    x = (centres[rng.integers(0, 40, 1_000)] + 1.5 * rng.normal(size=(1_000, 64))).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:04d}", 1, "u", "k", v.tolist()) for i, v in enumerate(x)], "id string, created_at long, universe_id string, kind string, vector array<float>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = {(f"v{i:04d}", f"v{j:04d}") for i, row in enumerate(np.argsort(-s, axis=1)[:, :5]) for j in row}
    found = {p: {(r.id, r.other_id) for r in neighbours.nearest_records(df, shard=31, probes=p).collect()} for p in (None, 4)}
    assert len(found[None] & want) / len(want) >= 0.9 > len(found[4] & want) / len(want)


def test_unusable_vectors_versions_and_ties(spark):
    unit = [1.0] + [0.0] * 63
    bad = [[float("nan")] + unit[1:], [0.0] * 64, unit[:63], None, [None] + unit[1:], [float("inf")] + unit[1:]]
    rows = [("a", "u", "k", 1, unit), ("b", "u", "k", 2, unit), ("b", "u", "k", 2, unit), ("c", "u", "k", 1, unit), ("c", "u", "k", 2, bad[0]), ("d", None, "k", 1, unit), ("e", None, "k", 1, unit), (None, "u", "k", 1, unit), ("f", "u", None, 1, unit)]
    rows += [(f"z{i}", "u", "k", 1, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame(rows, "id string, universe_id string, kind string, created_at long, vector array<float>").withColumn("other_id", F.lit(1))
    got = {(r.id, r.other_id, round(r.similarity, 6)) for r in neighbours.nearest_records(df).collect()}
    assert got == {("a", "b", 1.0), ("b", "a", 1.0), ("d", "e", 1.0), ("e", "d", 1.0)}
    assert neighbours.nearest_records(df.limit(0)).count() == 0


# --- languages ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def samples(spark):
    return table(spark, SF_DIR, "lang_samples")


@pytest.fixture(scope="module")
def sample_rows(samples):
    return [(r.lang, r.text) for r in samples.collect()]


def test_held_out_languages(sample_rows):
    right = 0
    for k in range(4):
        model = languages.LetterModel([s for i, s in enumerate(sample_rows) if i % 4 != k])
        right += sum([x for x, _ in languages.detect(model, t)[0]] == [lang] for i, (lang, t) in enumerate(sample_rows) if i % 4 == k)
    assert right >= 0.99 * len(sample_rows)


def test_mixed_and_quoted_languages(spark, samples, sample_rows):
    of = lambda lang: [t for x, t in sample_rows if x == lang]
    en, fr, de = of("en"), of("fr"), of("de")
    quote = re.split(r"(?<=[.!?])\s", de[1])[0][:80] + "."
    rows = [("mixed", f"{en[0]} {en[1]}\n\n{fr[0]} {fr[1]}"), ("quoted", f"{en[2]} {quote} {en[3]}"), ("short", "Tiny text."), ("null", None), ("empty", ""), ("long", " ".join(en) * 40)]
    df = spark.createDataFrame(rows + rows[:1], "id string, text string").withColumn("langs", F.lit("clash"))
    found = languages.detect_languages(df, samples).collect()
    got = {r.id: [x.lang for x in r.langs] for r in found}
    assert got == {"mixed": ["en", "fr"], "quoted": ["en"], "long": ["en"]} and len(found) == 4
    seg = next(r.segments for r in found if r.id == "mixed")
    assert [s.lang for s in seg] == ["en", "fr"] and abs(seg[0].end - len(en[0]) - len(en[1]) - 3) <= 3
    assert languages.detect_languages(df.limit(0), samples).count() == 0 and languages.detect_languages(df, samples.limit(0)).count() == 0


def test_unknown_scripts(sample_rows):
    model = languages.LetterModel(sample_rows)
    text = "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива. OK"
    langs, segments = languages.detect(model, text)
    assert langs[0][0] == languages.UNKNOWN and langs[0][1] > 0.9 and segments == [(0, len(text), languages.UNKNOWN, langs[0][1])]
    english = next(t for x, t in sample_rows if x == "en")
    assert [x for x, _ in languages.detect(model, english + " Добрый вечер")[0]] == ["en"]


def test_labels(spark):
    names = ["EN", "deu", "fr-FR", "Spanish", " pt_BR ", "und", "", None, "??", "Nederlands"]
    df = spark.createDataFrame([(n,) for n in names], "l string")
    assert [r[0] for r in df.select(languages.label_language(F.col("l"))).collect()] == ["en", "de", "fr", "es", "pt", None, None, None, None, "nl"]


# --- chats --------------------------------------------------------------------------------

M = "id string, chat_id string, role string, content string, created_at long, turn string"


def talk(spark, rows, known=("c",)):
    m = spark.createDataFrame([(*r, "clash") for r in rows], M)
    c = spark.createDataFrame([(k, "t") for k in known], "id string, title string")
    return sorted(tuple(r) for r in chats.conversations(m, c).select("chat_id", "message_id", "turn").collect())


def test_conversation_order_roles_and_copies(spark):
    t = 1_700_000_000
    rows = [("s", "c", "System", "", t * 1000), ("u1", " c ", "HUMAN", "ask?", t), ("a1", "c", "ai", "part", t * 1000), ("a1", "c", "ai", "the whole answer", t * 1000), ("a1", "c", "ai", None, t * 1000),
            ("tool", "c", "function", None, t * 1000), ("u2", "c", "user", "more " * 20_000, (t + 5) * 1000), ("a2", "c", "bot", "yes", (t + 9) * 1000), ("lost", None, "user", "x", t)]
    assert talk(spark, rows) == [("c", "a1", 4), ("c", "a2", 6), ("c", "s", 1), ("c", "tool", 3), ("c", "u1", 2), ("c", "u2", 5)]


@pytest.mark.parametrize("bad", [("x", "c", "narrator", "hm", 3), ("x", "c", "user", "no time", None), ("x", "c", "user", "no answer", 3), (None, "c", "system", "no id", 3), ("x", "c", None, "hm", 3)])
def test_broken_conversations(spark, bad):
    good = [("u", "c", "user", "a", 1), ("a", "c", "assistant", "b", 2)]
    assert talk(spark, good) and talk(spark, [*good, bad]) == []


def test_blank_unknown_and_empty_chats(spark):
    good = [("u", "c", "user", "a", 1), ("a", "c", "assistant", "b", 2)]
    assert talk(spark, good, known=("other",)) == [] and talk(spark, []) == []
    assert talk(spark, [good[0], ("a", "c", "assistant", " ​ ", 2)]) == []
    assert talk(spark, [good[1]]) == [] and talk(spark, [("s", "c", "system", "only", 1)]) == []


def test_links_decide_parent_and_depth_but_no_rows(spark, monkeypatch):
    m, c = table(spark, SF_DIR, "messages"), table(spark, SF_DIR, "chats")
    rows = lambda df: sorted(tuple(r) for r in df.select("chat_id", "message_id", "turn").collect())
    linked = chats.conversations(m, c)
    want, links = rows(linked), chats.reply_links
    assert want and linked.filter("depth > 0 AND parent_id IS NOT NULL").count() == linked.filter("turn > 1").count()
    monkeypatch.setattr(chats, "reply_links", lambda ordered, candidates: links(ordered, candidates, new_thread_below=9.0))
    apart = chats.conversations(m, c)
    assert rows(apart) == want and apart.filter("depth > 0 OR parent_id IS NOT NULL").count() == 0
    monkeypatch.setattr(chats, "reply_links", None)  # nothing that p6_found leaves out is computed for it
    assert rows(chats.p6_found(spark, SF_DIR)) == want


def test_interleaved_threads_separate(spark):
    rows = [("1", "ch", "user", "kiln glaze temperature", 0, 1), ("2", "ch", "user", "harbour ferry timetable", 1_000, 2), ("3", "ch", "assistant", "the kiln glaze temperature is 900", 60_000, 3), ("4", "ch", "assistant", "see 2 : ferry timetable harbour", 61_000, 4)]
    df = spark.createDataFrame(rows, "id string, chat_id string, role string, content string, at long, turn long")
    got = {r.id: r.parent for r in chats.reply_links(df, new_thread_below=1.0).collect()}
    assert got == {"1": None, "2": None, "3": "1", "4": "2"}
    assert {(r.message_id, r.thread, r.depth) for r in chats.threads(df).collect()} == {("1", "1", 0), ("2", "2", 0), ("3", "1", 1), ("4", "2", 1)}


def test_parents_are_the_best_of_all_messages_before(spark):
    rng = random.Random(5)
    rows = []
    for turn in range(1, 71):
        words = rng.sample(["kiln", "ferry", "glaze", "harbour", "orchard", "survey", "timber"], 3)
        if turn > 6 and turn % 3:
            words += [f"m{max(1, turn - rng.randrange(5, 25)):03d}"]
        rows.append((f"m{turn:03d}", "c", rng.choice(["user", "assistant", "tool"]), " ".join(words), turn * 200_000, turn))
    got = {r.id: r.parent for r in chats.reply_links(spark.createDataFrame(rows, "id string, chat_id string, role string, content string, at long, turn long")).collect()}
    fits = {("assistant", "user"), ("assistant", "tool"), ("tool", "user"), ("tool", "assistant"), ("user", "assistant"), ("user", "system")}

    def score(a, b):
        wa, wb = set(a[3].split()), set(b[3].split())
        return 1 / (1 + (a[4] - b[4]) / 60_000) + len(wa & wb) / len(wa) + ((a[2], b[2]) in fits) + 2 * (b[0] in a[3]) - 0.25 * (a[5] - b[5] - 1)

    want = {a[0]: max(rows[:i], key=lambda b, a=a: (score(a, b), b[5]), default=(None,))[0] for i, a in enumerate(rows)}
    assert got == want and any(w and int(i[1:]) - int(w[1:]) > 4 for i, w in want.items())


# --- near-duplicates ----------------------------------------------------------------------


def edited(words, rng, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_match_brute_force(spark, block):
    """``block`` 3 makes every shared key a hot one, which is compared block by block."""
    rng = random.Random(11)
    base = [[f"w{rng.randrange(400)}" for _ in range(120)] for _ in range(12)]
    texts = [edited(b, rng, k) for b in base for k in (0, 0, 1, 2, 4, 6, 9)] + [" ".join(f"r{rng.randrange(500)}" for _ in range(60)) for _ in range(40)]
    texts += ["too short", None, "", "A, b! " * 9, " ".join(base[0][60:] + base[0][:60])]
    rows = [(f"t{i:03d}", t, 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:5] + [(None, texts[0], 0)], "id string, text string, doc long")
    members, links = neardups.near_duplicates(df, block=block)
    got = {tuple(r) for r in neardups.all_pairs(members, links).collect()}
    sets = {i: neardups.shingle_set(w) for i, t, _ in rows if t and len(w := neardups.words_of(t)) >= 20}
    want = {(a, b) for a in sets for b in sets if a < b and neardups.jaccard(sets[a], sets[b]) >= 0.70}
    assert got <= want and len(want - got) <= 0.02 * len(want)


def test_near_duplicates_of_nothing_and_large_classes(spark):
    members, links = neardups.near_duplicates(spark.createDataFrame([], "id string, text string"))
    assert members.count() == 0 and links.count() == 0
    many = spark.createDataFrame([(1, f"i{i}") for i in range(6)], "class long, id string")
    for listed in (2, 1_000):
        pairs = neardups.all_pairs(many.unionByName(spark.createDataFrame([(2, "j0"), (2, "j1"), (2, "i0")], many.schema)), spark.createDataFrame([(1, 2)], "a long, b long"), listed)
        got = [tuple(r) for r in pairs.collect()]
        assert len(got) == len(set(got)) and set(got) == {(f"i{a}", f"i{b}") for a in range(6) for b in range(a + 1, 6)} | {(f"i{a}", f"j{b}") for a in range(6) for b in range(2)} | {("j0", "j1")}


def test_file_hashes(spark):
    rows = [("a", "ABC"), ("b", " sha256:abc "), ("c", "SHA256:ABC"), ("d", None), ("e", ""), ("a", "abc"), (None, "abc")]
    got = {tuple(r) for r in neardups.file_classes(spark.createDataFrame(rows, "id string, hash string")).collect()}
    assert got == {("abc", "a"), ("abc", "b"), ("abc", "c")}


# --- tokens -------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference_encoding():
    tiktoken = pytest.importorskip("tiktoken")
    lines = (line.split() for line in Path(tokens.VOCABULARY).read_bytes().splitlines() if line)
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in lines}, special_tokens={})


def test_ids_equal_the_library(spark, reference_encoding):
    rng = random.Random(2)
    texts = [None, "", " ", "<|endoftext|>", "�\x00é😀", "a" * 5_000, "é" * 3_000] + ["".join(rng.choice("etaoin shrdlu.,!?0123é中\n\t'") for _ in range(rng.randrange(1, 80))) for _ in range(2_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, ids int")
    enc = tokens.encoder()
    for r in tokens.encode_texts(df).collect():
        assert r.ids == reference_encoding.encode_ordinary(texts[r.doc_id] or "")
        assert enc.decode(r.ids) == (texts[r.doc_id] or "").encode()
    assert tokens.encode_texts(df.limit(0)).count() == 0


# --- mixing -------------------------------------------------------------------------------


def test_mix_meets_shares_and_caps(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["Big", "big ", "big", "sm-all", "Sm all"]) if i % 10 else "small", "word " * rng.randrange(1, 40), 9) for i in range(1_500)]
    rows = [(i, "sm_all" if s == "small" else s, t, c) for i, s, t, c in rows] + [(9_001, None, "x", 1), (9_002, "other", "x", 1), (9_003, "big", None, 1), (9_004, "big", "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, copy_no int")
    targets = spark.createDataFrame([("big", 0.5, 1), ("sm_all", 0.4, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.mix_sources(docs, targets).cache()
    report = {r.source: r for r in mixing.share_report(mix, targets).collect()}
    assert abs(report["big"].actual_share - 0.5 / 0.9) < 0.01 and abs(report["sm_all"].actual_share - 0.4 / 0.9) < 0.01 and report["none"].actual_share == 0
    assert report["big"].most_repeats == 1 and report["sm_all"].most_repeats <= 3
    assert mix.groupBy("doc_id", "copy_no").count().filter("count > 1").count() == 0
    assert mixing.mix_sources(docs.limit(0), targets).count() == 0 and mixing.mix_sources(docs, targets.limit(0)).count() == 0
    again = mixing.mix_sources(docs, targets)
    assert again.exceptAll(mix).count() == 0


def test_exponent_is_bisected_for_a_total_and_an_entropy(spark):
    rows = [(i, "a" if i % 10 else "b", "word " * (1 + i % 7)) for i in range(1_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 4)], "source string, target_share double, max_repeats int")
    sizes = {r.source: r.n for r in mixing.count_tokens(docs).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    whole = sum(sizes.values())
    got = {r.source: r for r in mixing.share_report(mixing.mix_sources(docs, targets, passes=1.0), targets).collect()}
    assert abs(sum(r.n_tokens for r in got.values()) - whole) <= 20
    e = mixing.exponent_for_total(sizes, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4}, whole)
    want = mixing.tempered(sizes, {"a": 0.5, "b": 0.5}, e)
    assert 0 <= e < 1 and all(abs(got[s].actual_share - want[s]) < 0.01 for s in want)
    got = {r.source: r.actual_share for r in mixing.share_report(mixing.mix_sources(docs, targets, entropy=0.9), targets).collect()}
    assert abs(-sum(w * np.log2(w) for w in got.values()) - 0.9) < 0.01 and got["a"] > got["b"]
    flat = mixing.powered(sizes, mixing.exponent_for_repeats(sizes, {"a": 1, "b": 4}, whole))
    assert abs(flat["b"] * whole / sizes["b"] - 4) < 1e-6 and mixing.exponent_for_repeats(sizes, {"a": 9, "b": 9}, whole) == 0
    got = {r.source: r for r in mixing.share_report(mixing.mix_sources(docs, targets, passes=1.0, flatten=True), targets).collect()}
    assert abs(got["b"].actual_share - flat["b"]) < 0.01 and got["b"].most_repeats == 4 and got["a"].most_repeats == 1
    for how in ({"passes": 5.0}, {"passes": 5.0, "flatten": True}, {"passes": 5.0, "entropy": 0.9}):
        with pytest.raises(ValueError):
            mixing.mix_sources(docs, targets, **how)


def test_block_permutation_against_brute_force(spark, monkeypatch):
    """The documents of a part pass are the first blocks in the seeded order, and of the next block the first documents."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 200)
    docs = spark.createDataFrame([(i, "a", "word " * (1 + i % 5)) for i in range(600)] + [(10_000 + i, "b", "word") for i in range(100)], "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen = {r.doc_id for r in mixing.mix_sources(docs, targets).filter("source = 'a'").collect()}
    tokens_of = {r.doc_id: r.n_tokens for r in mixing.count_tokens(docs).filter("source = 'a'").collect()}
    n_b = sum(r.n_tokens for r in mixing.count_tokens(docs).filter("source = 'b'").collect())
    blocks = -(-sum(tokens_of.values()) // 200)
    keys = docs.filter("source = 'a'").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(blocks)))
    keys = keys.select("doc_id", "block", F.xxhash64("block", "source", F.lit(42)).alias("b"), F.xxhash64("doc_id", F.lit(43)).alias("d")).collect()
    budget, so_far, want = 9 * n_b, 0, set()
    for r in sorted(keys, key=lambda r: (r.b, r.block, r.d, r.doc_id)):
        so_far += tokens_of[r.doc_id]
        if so_far - tokens_of[r.doc_id] / 2 > budget:
            break
        want.add(r.doc_id)
    assert len({r.block for r in keys if r.doc_id in chosen}) > 3 and chosen == want


def test_exponents():
    sizes, targets, caps = {"a": 900.0, "b": 100.0}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 4}
    assert mixing.exponent_for_total(sizes, targets, caps, 700) == 1.0
    e = mixing.exponent_for_total(sizes, targets, caps, 1_000)
    assert 0 <= e < 1 and abs(mixing.largest_total(sizes, mixing.tempered(sizes, targets, e), caps) - 1_000) < 1e-3
    assert abs(mixing.exponent_for_entropy(sizes, np.log(2))) < 1e-6 and abs(mixing.exponent_for_entropy(sizes, -(0.9 * np.log(0.9) + 0.1 * np.log(0.1))) - 1) < 1e-6


# --- encodings ----------------------------------------------------------------------------


def misread(s, codec):
    out = []
    for b in s.encode():
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


def test_misread_texts_come_back(spark, samples, sample_rows):
    clean = [t for _, t in sample_rows if re.search("[^\x00-\x7f]", t)][:80]
    rows, want = [], {}
    for i, t in enumerate(clean):
        for j, codec in enumerate(["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251"]):
            g = misread(t, codec)
            rows.append((i * 10 + j, g if i % 3 else f"Plain opening line.\n\n{g}"))
            want[i * 10 + j] = t if i % 3 else f"Plain opening line.\n\n{t}"
        g = misread(misread(t, "cp1252"), "cp1252")
        rows.append((i * 10 + 6, g))
        want[i * 10 + 6] = t
    odd = [(90_001, clean[0]), (90_002, "lost �� text"), (90_003, None), (90_004, ""), (90_005, "plain"), (90_006, "Привет “à la” ├── tree »É")]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").withColumn("fixed", F.lit("clash"))
    found = encodings.restore_texts(df, samples).collect()
    got = {r.doc_id: r.fixed for r in found}
    assert got.pop(90_002) is None and not any(k > 90_000 for k in got)
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.99 * len(want)
    assert hashlib.md5(b"abc").hexdigest() == encodings.md5_hex("abc")
    assert encodings.restore_texts(df.limit(0), samples).count() == 0
