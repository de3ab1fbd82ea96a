import base64
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from presq.llm.bpe import Encoder, bpe, encode_corpus, load_ranks
from presq.llm.leakage import leaked_items, leaks, without_leaks, words
from presq.llm.neighbours import chi_square, nearest, stop_factor
from presq.llm.queries import _vocabulary
from presq.llm.spans import shared_share, shared_spans

needs_vocabulary = pytest.mark.skipif(not Path(_vocabulary()).exists(), reason="no public vocabulary here")


@pytest.fixture(scope="module")
def ranks():
    return load_ranks(Path(_vocabulary()).read_bytes())


def slow_bpe(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(1 << 40, 0))
        if best[0] == 1 << 40:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.binary(min_size=1, max_size=60))
def test_bpe(ranks, word):
    assert bpe(word, ranks) == slow_bpe(word, ranks)


@needs_vocabulary
@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab 'sAé日1\n\t\x1c 🙂."), max_size=40))
def test_encoder(ranks, text):
    e = Encoder(ranks, memory=5)
    want = [i for w in e.words.findall(text) for i in slow_bpe(w.encode(), ranks)]
    assert e.encode(text) == want
    assert b"".join({v: k for k, v in ranks.items()}[i] for i in e.encode(text)).decode() == text


@needs_vocabulary
def test_corpus(spark, ranks):
    long = "ab " * 20_000 + "x" * 50_000
    docs = spark.createDataFrame([(1, "Hello world", 0), (2, None, 0), (3, "", 0), (4, long, 0), (5, "<|endoftext|>", 0)], "doc_id long, text string, ids int")
    got = {r.doc_id: r.ids for r in encode_corpus(docs, _vocabulary()).collect()}
    assert got[1] == [15496, 995] and got[2] == [] and got[3] == []
    e = Encoder(ranks)
    assert got[4] == e.encode(long) and 50256 not in got[5]
    assert encode_corpus(docs.limit(0), _vocabulary()).count() == 0
    assert base64.b64decode(b"IQ==") in ranks


def passage(k, n=20):
    return " ".join(f"word{k}x{i}" for i in range(n))


@pytest.mark.parametrize("set_bits", [27, 17])
def test_leaks(spark, set_bits):
    long = "filler " * 30_000
    texts = [
        (1, "before " + passage(1).upper().replace(" ", " -- ") + " after"),
        (2, " ".join(passage(1).split()[:12])),
        (3, long + " ".join(passage(2).split()[3:16]) + " tail"),
        (4, None),
        (5, ""),
        (6, passage(1) + " and " + passage(1)),
        (7, "Straße " + " ".join(f"w{i}" for i in range(14))),
    ]
    docs = spark.createDataFrame([(i, t, "z") for i, t in texts], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([("a", passage(1)), ("b", "“" + passage(1) + "”!"), ("c", passage(2)), ("d", "too short"), ("e", None), ("f", "STRASSE " + " ".join(f"w{i}" for i in range(14)))], "item_id string, passage string")
    found = leaks(docs, items, set_bits=set_bits)
    got = {(r.doc_id, r.item_id) for r in found.collect()}
    assert got == {(1, "a"), (1, "b"), (3, "c"), (6, "a"), (6, "b"), (7, "f")}
    spans = {(r.doc_id, r.item_id, r.span_start, r.span_end) for r in found.collect()}
    assert (1, "a", 7, len(texts[0][1]) - 6) in spans
    assert sum(s[0] == 6 and s[1] == "a" for s in spans) == 2
    assert {r.item_id: r.n_docs for r in leaked_items(found).collect()} == {"a": 2, "b": 2, "c": 1, "f": 1}
    assert {r.doc_id for r in without_leaks(docs, found).collect()} == {2, 4, 5}
    cut = {r.doc_id: r.text for r in without_leaks(docs, found, "span").collect()}
    assert cut[1] == "before  after" and cut[6] == " and " and cut[4] is None and cut[2] == texts[1][1]
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def test_cleaned_texts(spark, tmp_path):
    from presq.llm.queries import QUERIES

    texts = [(1, "before " + passage(1) + " after"), (2, "nothing of it"), (3, None)]
    spark.createDataFrame([(i, t, "en", "s", 7) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", passage(1))], "item_id string, passage string").write.parquet(f"{tmp_path}/eval_items.parquet")
    clean, cut = (QUERIES[n](spark, str(tmp_path)) for n in ("p7_clean_texts", "p7_cut_texts"))
    assert clean.columns == cut.columns == ["doc_id", "text", "lang", "source"]
    assert {r.doc_id: r.text for r in clean.collect()} == dict(texts[1:])
    assert {r.doc_id: r.text for r in cut.collect()} == {1: "before  after", **dict(texts[1:])}


def test_words():
    assert words("Ab-c_D 1²x İq") == ["ab", "c", "d", "1²x", "i̇q"]


def brute_spans(texts, length):
    where = {}
    for d, t in texts:
        for i in range(len(t or "") - length + 1):
            where.setdefault(t[i : i + length], set()).add(d)
    out = set()
    for d, t in texts:
        on = np.zeros(len(t or "") + 1, bool)
        for i in range(len(t or "") - length + 1):
            if len(where[t[i : i + length]]) > 1:
                on[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.r_[False, on]))
        out |= {(d, int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)}
    return out


@pytest.mark.parametrize(("length", "hot", "alphabet"), [(12, 64, "ab"), (12, 1, "abcdé🙂"), (40, 2, "abc"), (160, 64, "abcdefgh ")])
def test_spans(spark, length, hot, alphabet):
    rng = np.random.default_rng(length + hot)
    pick = lambda n: "".join(rng.choice(list(alphabet), n))
    shared = [pick(length * k) for k in (1, 2, 5)]
    texts = []
    for d in range(60):
        t = pick(int(rng.integers(0, 2 * length)))
        for s in rng.permutation(3)[: rng.integers(0, 4)]:
            at = int(rng.integers(0, length // 2))
            t += shared[s][at : at + int(rng.integers(length // 2, 5 * length))] + pick(int(rng.integers(0, 9)))
        texts.append((d, t))
    texts += [(60, None), (61, ""), (62, texts[5][1]), (63, texts[5][1]), (64, "a" * 5 * length), (65, "a" * 3 * length), (66, "b" * 7 * length)]
    docs = spark.createDataFrame([(d, t, 1) for d, t in texts], "doc_id long, text string, span_start int").repartition(3)
    spans = shared_spans(docs, length, batch_hot=hot)
    assert {tuple(r) for r in spans.collect()} == brute_spans(texts, length)
    share = {r.doc_id: r for r in shared_share(docs, spans).collect()}
    assert share[60].n_chars == 0 and share[64].shared_chars == 5 * length
    assert shared_spans(docs.limit(0), length).count() == 0


def test_stop_test():
    assert abs(chi_square(stop_factor(8, 0.999), 8) - 0.999) < 1e-9
    assert abs(stop_factor(8, 0.95) - 15.507) < 1e-2


@pytest.mark.parametrize("repair", [8 << 20, 0])
def test_spans_are_compared(spark, monkeypatch, repair):
    """Hashes that meet by chance are found out by the texts: windows are looked up, or the search is made again."""
    import presq.llm.spans as spans

    monkeypatch.setattr(spans, "REPAIR_BYTES", repair)
    rng = np.random.default_rng(3)
    texts = [(d, "".join(rng.choice(list("abc"), 120))) for d in range(30)] + [(50, "x" * 5 + "abcabcabcacb" * 3), (51, "abcabcabcacb" * 3 + "y")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    searches, real = [], spans._picker

    def picker(length, k, hot, seed, parts):
        searches.append(seed)
        run = real(length, k, hot, seed, parts)

        def weak(batches):
            import presq.llm.spans as inside

            mix = inside._mix
            if seed == 0:
                inside._mix = lambda h: mix(h) & np.uint64(63)
            try:
                yield from run(batches)
            finally:
                inside._mix = mix

        return weak

    monkeypatch.setattr(spans, "_picker", picker)
    assert {tuple(r) for r in shared_spans(docs, 12).collect()} == brute_spans(texts, 12)
    assert searches == ([0] if repair else [0, 1])


def test_chance_of_a_cut_off_neighbour():
    from presq.llm.neighbours import _home, _touched, layout, log_cut_off

    rng = np.random.default_rng(8)
    points = rng.standard_normal((4000, 4))
    nodes = layout(points, 16)
    home = _home(nodes, points)
    assert np.bincount(home).min() > 80 and home.max() == 15
    p, d = points[:200], np.full(200, 0.3)
    moved = p[:, None] + 0.3 * rng.standard_normal((200, 500, 4))
    left = (_home(nodes, moved.reshape(-1, 4)).reshape(200, 500) != home[:200, None]).mean()
    assert abs(np.exp(log_cut_off(nodes, p, d)).mean() - left) < 0.01
    row, cell = _touched(nodes, p, np.full(200, 0.09))
    near = moved[np.linalg.norm(moved - p[:, None], axis=2) <= 0.3]
    owner = np.nonzero(np.linalg.norm(moved - p[:, None], axis=2) <= 0.3)[0]
    assert set(zip(owner.tolist(), _home(nodes, near).tolist(), strict=True)) <= set(zip(row.tolist(), cell.tolist(), strict=True))


@pytest.mark.parametrize(("cell_rows", "trees"), [(20_000, 48), (60, 48), (60, 2)])
def test_nearest(spark, cell_rows, trees):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12, 16))
    v = np.concatenate([b + 0.25 * rng.standard_normal((25, 16)) for b in base]).astype(np.float32)
    data = [(f"id{i:03}", x.tolist(), 0) for i, x in enumerate(v)]
    data += [(f"copy{i}", v[0].tolist(), 0) for i in range(9)]
    bad = [("null", None, 0), ("short", [1.0] * 15, 0), ("empty", [], 0), ("zero", [0.0] * 16, 0), ("nan", [float("nan")] * 16, 0), ("inf", [float("inf")] * 16, 0), ("gap", [None] * 16, 0), (None, v[3].tolist(), 0)]
    df = spark.createDataFrame(data + bad + data[:20], "id string, vec array<float>, sim int")
    got = {}
    for r in nearest(df, 16, 5, 0.5, cell_rows=cell_rows, most_trees=trees).collect():
        got.setdefault(r.id, set()).add(r.other)
    ids = np.array([d[0] for d in data])
    x = np.array([d[1] for d in data], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sim = np.round(x @ x.T, 12)
    np.fill_diagonal(sim, -9)
    hits = total = 0
    for i in range(len(ids)):
        order = sorted(range(len(ids)), key=lambda j: (-sim[i, j], ids[j]))[:5]
        want = {ids[j] for j in order if sim[i, j] >= 0.5}
        assert got.get(ids[i], set()) <= set(ids) - {ids[i]} and len(got.get(ids[i], ())) <= 5
        hits, total = hits + len(want & got.get(ids[i], set())), total + len(want)
    assert hits >= 0.99 * total
    assert nearest(df.limit(0), 16).count() == 0


def brute_nearest(v, k, least):
    x = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    sim = np.round(x @ x.T, 12)
    np.fill_diagonal(sim, -9)
    return {(i, int(j)) for i in range(len(v)) for j in np.lexsort((np.arange(len(v)), -sim[i]))[:k] if sim[i, j] >= least}


def test_all_cells_in_reach_take_bounded_memory(spark, monkeypatch):
    """Vectors that trees don't settle: no batch holds all the cells of many vectors, and no task all that ask in a cell."""
    import presq.llm.neighbours as near

    rng = np.random.default_rng(9)
    v = rng.standard_normal((600, 8)).astype(np.float32)
    df = spark.createDataFrame([(f"{i:03}", x.tolist()) for i, x in enumerate(v)], "id string, vec array<float>")
    # the step that works out the cells in reach is caught, to be run on one large batch here
    caught, real = [], type(df).mapInArrow

    def watch(self, func, schema, *rest):
        if schema == near._CELL_SCHEMA and self.columns == ["rep", "vec", "bound"]:
            caught.append(func)
        return real(self, func, schema, *rest)

    monkeypatch.setattr(type(df), "mapInArrow", watch)
    monkeypatch.setattr(near, "TREES", (1, 1, 1))
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(conf, "50")
    report = []
    try:
        got = {(int(r.id), int(r.other)) for r in near.nearest(df, 8, 5, 0.2, cell_rows=20, most_trees=1, report=report).collect()}
    finally:
        spark.conf.unset(conf)
    want = brute_nearest(v, 5, 0.2)
    assert len(got & want) >= 0.995 * len(want) and len(got) == len(want)
    many = 20_000
    batch = near.pa.RecordBatch.from_arrays([near.pa.array([f"{i:05}" for i in range(many)]), near.pa.array([v[i % 600].tobytes() for i in range(many)], near.pa.binary()), near.pa.array([0.5] * many)], names=["rep", "vec", "bound"])
    sizes = [[x.num_rows for x in func(iter([batch])) if x["role"][0].as_py() == near.ASKS] for func in caught]
    sizes = max(sizes, key=sum)
    assert sum(sizes) > 10 * many and max(sizes) <= many
    assert report[-1]["trees"] == 0 and report[-1]["portions"] > 1


def test_trees_go_on_while_they_cost_less(spark, monkeypatch):
    import presq.llm.neighbours as near

    rng = np.random.default_rng(9)
    v = rng.standard_normal((600, 8)).astype(np.float32)
    df = spark.createDataFrame([(f"{i:03}", x.tolist()) for i, x in enumerate(v)], "id string, vec array<float>")
    monkeypatch.setattr(near, "TREES", (1, 1, 1))
    report = []
    got = {(int(r.id), int(r.other)) for r in near.nearest(df, 8, 5, 0.2, cell_rows=20, most_trees=3, report=report).collect()}
    want = brute_nearest(v, 5, 0.2)
    assert len(got & want) >= 0.995 * len(want)
    assert 3 < sum(r["trees"] for r in report) <= 6
