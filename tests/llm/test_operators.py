"""The operators on small tables: brute force, nulls, ties, repeated rows, empty tables, clashing columns."""

import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from waymark.llm import common, decontaminate, exact_dedup, language_id, line_dedup, ngram_jaccard, packing, quality, token_output, tokens, toxicity, url_filter

public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that operators use inside.
CLASHES = ("id", "th", "row", "score", "removed", "rid", "key", "path", "host", "stats", "length", "label", "kept", "n", "bucket")


def words(r, n, vocabulary=400):
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def corpus(seed=1):
    r = random.Random(seed)
    shared = ["\n".join(" ".join(words(r, 6)) for _ in range(4)) for _ in range(3)]
    docs = {}
    for i in range(60):
        lines = [" ".join(words(r, r.randint(1, 9), 5000)) for _ in range(r.randint(1, 12))]
        if r.random() < 0.4:
            lines.insert(r.randrange(len(lines) + 1), r.choice(shared))
        if r.random() < 0.2:
            lines.insert(r.randrange(len(lines) + 1), "  ")
        docs[i] = "\n".join(lines)
    for i in range(60, 90):
        base = docs[r.randrange(60)].split(" ")
        for _ in range(r.randint(0, 2)):
            base[r.randrange(len(base))] = "edited"
        docs[i] = " ".join(base)
    docs |= {90: None, 91: "", 92: " \n\t ", 93: "one", 94: "one", 95: "ONE two", 96: docs[3].upper(), 97: "same line\n" * 40, 98: " ".join(words(r, 30_000, 50))}
    return docs


def frame(spark, docs, clash=False):
    df = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs.items()], DOCS).repartition(3)
    return df.select("*", *(F.lit(7).alias(c) for c in CLASHES)) if clash else df


@pytest.fixture(scope="module")
def docs():
    return corpus()


@pytest.mark.parametrize("clash", [False, True])
def test_line_dedup(spark, docs, clash):
    df = frame(spark, docs, clash)
    got = line_dedup.dedup_lines(df)
    assert set(got.columns) == set(df.columns) | {"removed"}
    want = brute.dedup_lines(docs)
    for r in got.collect():
        assert (r.text, sum(s["last"] - s["first"] + 1 for s in r.removed)) == want[r.doc_id]


def test_line_dedup_repeated_rows_and_empty(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", "", "", 1)] * 2 + [(None, "x\ny\nz", "", "", 1), (2, "x\ny\nz\nw", "", "", 1)], DOCS)
    got = sorted(((r.doc_id or 0, r.text) for r in line_dedup.dedup_lines(rows).collect()))
    assert got == [(0, "x\ny\nz"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "w")]
    assert line_dedup.dedup_lines(rows.limit(0)).count() == 0


def test_without_merges_spans():
    assert line_dedup.without("a\nb\nc\nd\ne", [{"first": 1, "last": 2}, {"first": 2, "last": 3}]) == ("a\ne", [(1, 3)])


def test_pieces_are_cut_like_lines():
    r = random.Random(11)
    for _ in range(2000):
        text = "".join(r.choice("ab \n") for _ in range(r.randint(1, 12)))
        n = text.count("\n") + 1
        spans = [{"first": a, "last": r.randrange(a, n)} for a in (r.randrange(n) for _ in range(r.randint(1, 3)))]
        if text.split("\n")[-1]:
            assert line_dedup.without_pieces(text, spans)[0] == line_dedup.without(text, spans)[0]
    long = "The own start. " + "x" * 100 + ". End of it.\nnext"
    assert line_dedup.without_pieces(long, [{"first": 1, "last": 2}]) == ("The own start. \nnext", [(15, len(long) - 6)])
    x = "y" * 100
    assert [p.strip() for p in line_dedup.pieces_of(f"   Ok. No. Longer one. {x}.  ")] == [p.strip() for p in line_dedup.pieces_of(f"Ok. No. Longer one. {x}.")] + [""]


def test_passages_inside_lines(spark):
    r = random.Random(12)
    sentence = lambda: " ".join(words(r, 12, 5000)) + "."
    passage = " ".join(sentence() for _ in range(4))
    own = [sentence() for _ in range(6)]
    short = "Yes. No. So! "
    docs = {1: f"{own[0]} {passage} {own[1]}", 2: f"{own[2]} {passage} {own[3]}\n{own[4]}", 3: passage, 4: short + own[5], 5: short + own[0] + " " + own[4]}
    got = {d.doc_id: d for d in line_dedup.dedup_passages(frame(spark, docs, True)).collect()}
    assert {d: x.text for d, x in got.items()} == docs | {2: f"{own[2]} {own[3]}\n{own[4]}", 3: ""}
    (gone,) = got[2].removed
    assert docs[2][gone["first"] : gone["last"] + 1] == passage + " "


def test_passages_that_begin_and_end_inside_sentences(spark):
    r = random.Random(16)
    clause = lambda: " ".join(words(r, 8, 5000))
    inside = ", ".join(clause() for _ in range(5)) + "; " + clause() + "."
    docs = {i: f"{clause()} {inside} {clause()}" for i in (1, 2)}
    got = {d.doc_id: d.text for d in line_dedup.dedup_passages(frame(spark, docs)).collect()}
    # the first clause has other words before it and stays
    head = docs[2].split(", ")[0]
    assert got == {1: docs[1], 2: f"{head}, {docs[2].split('. ')[1]}"}


def test_pieces_are_the_same_in_spark_and_python(spark):
    r = random.Random(17)
    part = lambda: r.choice([*["word"] * 9, *"     ", "  ", ", ", "; ", ": ", ". ", "! ", '." ', "?) ", "\n", "\t", "\u3002", "\u00fcber", ",", "."])
    texts = ["".join(part() for _ in range(r.randint(1, 120))) for _ in range(400)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", line_dedup.full_pieces(F.col("text")).alias("p")).collect()
    blanks = line_dedup.BLANKS + "\n"
    for row in got:
        pieces = line_dedup.pieces_of(texts[row.i])
        assert "".join(pieces) == texts[row.i]
        assert [(x.i, x.t) for x in row.p] == [(i, p.strip(blanks)) for i, p in enumerate(pieces) if p.strip(blanks)]
    for line in (x for t in texts for x in t.split("\n")):
        bare = line.strip(line_dedup.BLANKS)
        same = lambda t: [p.strip(blanks) for p in line_dedup.pieces_of(t) if p.strip(blanks)]
        assert same(f" \t  {bare}    ") == same(bare)


@pytest.mark.parametrize("clash", [False, True])
def test_passages_of_short_lines_are_lines(spark, docs, clash):
    plain = {d: t for d, t in docs.items() if d != 98}
    want = brute.dedup_lines(plain)
    assert {r.doc_id: r.text for r in line_dedup.dedup_passages(frame(spark, plain, clash)).collect()} == {d: t for d, (t, _) in want.items()}


@pytest.mark.parametrize("k,t,block,light", [(3, 90, 512, 48), (3, 80, 4, 2), (5, 80, 512, 48), (1, 60, 8, 3)])
def test_ngram_jaccard(spark, docs, monkeypatch, k, t, block, light):
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "LIGHT", light)
    monkeypatch.setattr(ngram_jaccard, "PAIRED", 2 * light)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.jaccard_groups(frame(spark, docs, True), k, t).collect()}
    assert got == brute.groups(docs, k, t)


def test_ngram_jaccard_repeated_null_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(5, text, "", "", 1)] * 2 + [(None, text, "", "", 1), (9, text + " more", "", "", 1), (None, None, "", "", 1)], DOCS)
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_jaccard.jaccard_groups(rows).collect()))
    assert got == [(0, 0, 0), (0, 58, 5), (5, 58, 5), (5, 58, 5), (9, 59, 5)]
    assert ngram_jaccard.jaccard_groups(rows.limit(0)).count() == 0


def test_near_copies_of_one_text(spark):
    """A group in which every pair shares frequent tokens."""
    r = random.Random(3)
    base = words(r, 120, 10_000)
    docs = {}
    for i in range(120):
        own = list(base)
        for _ in range(r.randint(0, 3)):
            own[r.randrange(len(own))] = f"x{r.randrange(10**6)}"
        docs[i] = " ".join(own)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.jaccard_groups(frame(spark, docs)).collect()}
    assert got == brute.groups(docs, 3, 90)


def test_star(spark):
    r = random.Random(0)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(30)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in common.star(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in root}


def test_star_plans_stay_small_over_rounds(spark):
    ids = random.Random(1).sample(range(20), 20)
    found = common.star(spark.createDataFrame(list(zip(ids, ids[1:])), "u bigint, v bigint"))
    # the estimate had four times the digits after each round
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 1 << 200
    assert {(r.node, r.root) for r in found.collect()} == {(i, 0) for i in ids}


RULES = [url_filter.Rule("org", "/", "allow"), url_filter.Rule("example.org", "/es/", "block"), url_filter.Rule("a.example.org", "/", "allow"), url_filter.Rule("com", "/de/", "block"), url_filter.Rule("com", "/de/x/y/z", "allow")]


def judge(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut].translate(brute.AZ), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.name), len(r.host)), default=None)
    return host, path, best.name if best else None, best.verdict if best else "allow"


def test_url_filter(spark):
    r = random.Random(2)
    hosts = ["example.org", "a.example.org", "b.a.example.org", "xorg", "org", "ORG", "shop.com", "com", "example.net", "a..org", ""]
    urls = [f"http://{r.choice(hosts)}{r.choice(['', '/', '/es/', '/es', '/de/x/y/z1', '/de/q?x=/es/', '#/de/', '?a'])}" for _ in range(300)]
    urls += [None, "", "no scheme", "a://b://c/de/", "://x.com/de/", "http://é.org/ü"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").select("*", *(F.lit(1).alias(c) for c in CLASHES))
    for parts in (1, 7):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, RULES, parts=parts).collect()}
        assert got == {i: judge(u) for i, u in enumerate(urls)}
    assert url_filter.filter_urls(pages.limit(0), RULES).count() == 0
    assert {r.rule for r in url_filter.filter_urls(pages, []).collect()} == {None}
    twice = spark.createDataFrame([(1, "http://a.org/")] * 2, "page_id bigint, url string")
    assert url_filter.filter_urls(twice, [url_filter.Rule("org", "/", "allow"), url_filter.Rule("org", "/", "block")]).select("verdict").collect() == [("block",)] * 2


@pytest.mark.parametrize("counters", [None, 1])
def test_exact_dedup(spark, docs, counters):
    own = docs | {i: docs[5] for i in range(200, 320)}
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(frame(spark, own, True), counters=counters).collect()}
    by = {}
    for d, t in own.items():
        by.setdefault(t or "", []).append(d)
    for d, t in own.items():
        same = by[t or ""]
        assert tuple(got[d]) == (d, max(same), len(same), d == max(same), hashlib.sha256((t or "").encode()).hexdigest())


def test_exact_dedup_ties(spark):
    rows = spark.createDataFrame([(1, "x", "", "", 1)] * 3 + [(None, "x", "", "", 1), (None, "y", "", "", 1)], DOCS)
    got = exact_dedup.exact_dedup(rows).collect()
    assert sorted((r.text_sha256[:4], r.kept) for r in got if r.kept) == sorted((hashlib.sha256(x.encode()).hexdigest()[:4], True) for x in ("x", "y"))
    assert exact_dedup.exact_dedup(rows.limit(0)).count() == 0


def test_misra_gries_names_the_frequent():
    import pyarrow as pa

    values = [b"hot"] * 500 + [str(i).encode() for i in range(1000)]
    random.Random(0).shuffle(values)
    batches = [pa.RecordBatch.from_pydict({"d": values[i : i + 100]}) for i in range(0, len(values), 100)]
    (found,) = exact_dedup.misra_gries(batches, "d", 10)
    assert b"hot" in found.column("digest").to_pylist() and found.num_rows <= 10


@functools.cache
def whole_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def reference_ids(text):
    return [*whole_tokenizer().encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder():
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(TOKENIZER), tokens.Encoder(TOKENIZER, 2, limit=50)
    letters = "aB'sé \t\n\u0130\u03a3\u03c2\x1c\x85\xa0  字1\u0663.,!\u200b\u3000\x00ßÉ\u0301ÿ;|"
    r = random.Random(4)
    for _ in range(3000):
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 14))) + r.choice(["", "<|endoftext|>", "it's ", "word. Word, word!!"])
        assert np.frombuffer(own.ids(text), "<u4").tolist() == [*whole.encode(text, add_special_tokens=False).ids, 2]


def test_packing(spark, docs):
    size = 64
    df = frame(spark, docs, True).unionByName(frame(spark, {93: "one"}, True))
    got = packing.pack(df, TOKENIZER, eos=2, size=size).collect()
    whole = {d: reference_ids(t) for d, t in docs.items()}
    cells, covered = {}, {}
    for r in got:
        own = np.array(whole[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(whole[r.doc_id])
        cells.setdefault(r.sequence_id, []).append((r.offset, r.length))
        covered.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    for placed in cells.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= size
    assert {d: sorted(c) for d, c in covered.items()} == {d: sorted(list(range(len(w))) * (2 if d == 93 else 1)) for d, w in whole.items()}
    used = sum(r.length for r in got)
    assert used / (size * len(cells)) > 0.9
    assert packing.pack(df.limit(0), TOKENIZER, eos=2).count() == 0


def test_shortest_pack_first():
    r = random.Random(0)
    histogram = {n: r.randint(1, 50) for n in range(1, 101)}
    patterns = packing.shortest_pack_first(histogram, 100)
    placed = {}
    for count, pattern in patterns:
        assert sum(n * t for n, t in pattern) <= 100
        for n, t in pattern:
            placed[n] = placed.get(n, 0) + count * t
    assert placed == histogram
    assert sum(c for c, _ in packing.shortest_pack_first({10: 1000}, 100)) == 100


def test_token_output(spark, docs):
    size = 128
    got = token_output.packed_sequences(frame(spark, docs, True), TOKENIZER, eos=2, size=size, pad=1, block_tokens=4000).collect()
    whole = {d: reference_ids(t) for d, t in docs.items()}
    back = {d: [None] * len(w) for d, w in whole.items()}
    for r in got:
        ids, positions = np.frombuffer(r.ids, "<u2"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == len(positions) == size and (ids[r.cu_seqlens[-1] :] == 1).all()
        for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            back[d][start : start + b - a] = ids[a:b].tolist()
            assert positions[a:b].tolist() == list(range(b - a))
    assert back == whole
    assert token_output.packed_sequences(frame(spark, docs).limit(0), TOKENIZER).count() == 0


def test_token_output_files_and_width(spark, tmp_path):
    df = frame(spark, {1: "a b c", 2: "d e"})
    path = str(tmp_path / "packed")
    token_output.write(token_output.packed_sequences(df.coalesce(1), TOKENIZER, eos=2, size=8), path)
    ids, positions, ends = token_output.matrix(spark.read.parquet(path), 0)
    assert ids.shape == positions.shape == (1, 8) and ends == [[0, 4, 7]]
    with pytest.raises(Exception, match="does not fit"):
        token_output.packed_sequences(df, TOKENIZER, eos=70_000, size=8).collect()


def test_best_fit_decreasing():
    r = random.Random(1)
    lengths = [r.randint(1, 60) for _ in range(500)]
    rooms, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [x for x in rooms if x >= lengths[i]]
        rooms.remove(min(fits)) if fits else None
        rooms.append((min(fits) if fits else 60) - lengths[i])
    got = token_output.best_fit_decreasing(lengths, 60)
    assert sorted(x for s in got for x in s) == list(range(500)) and len(got) == len(rooms)
    assert all(sum(lengths[i] for i in s) <= 60 for s in got)
    del want


LANGUAGES = {"aa": "bdfgkl", "bb": "mnprst", "cc": "vwxzjh"}


def language_rows(n):
    r = random.Random(5)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(LANGUAGES))
        rows.append((i, " ".join("".join(r.choice(LANGUAGES[lang]) + r.choice("aeiou") for _ in range(3)) for _ in range(20)), lang, "s", 1))
    return rows


def test_language_id(spark):
    rows = language_rows(300) + [(900, None, "aa", "s", 1), (901, "12 !?", "aa", "s", 1), (902, "", None, "s", 1), (None, "bada faga", None, "s", 1)]
    df = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(1).alias(c) for c in CLASHES))
    model = language_id.fit(df.where("doc_id % 5 <> 0"))
    got = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    held = [r for r in rows[:300] if r[0] % 5 == 0]
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.95 * len(held)
    assert [(got[i].lang_pred, got[i].score) for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert all(0 <= r.score <= 1 for r in got.values())
    none = language_id.identify(df, language_id.fit(df.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_id.identify(df.limit(0), model).count() == 0


def test_filters_hold_all_their_grams():
    grams = common.mix(np.arange(1, 5000, dtype=np.uint64))
    slots = np.zeros(1 << 16, np.uint8)
    for j in range(language_id.HASHES):
        slots[language_id.slots_of(grams, len(slots), j)] |= np.uint8(4)
    assert all((slots[language_id.slots_of(grams, len(slots), j)] & 4).all() for j in range(language_id.HASHES))


def judged_rows():
    r = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        good, toxic = r.random() < 0.7, r.random() < 0.3
        own = words(r, 40, 3000) if good else ["spam!!"] * 40
        if toxic:
            own[r.randrange(40)] = r.choice(["vilewordone", "vilewordtwo", "rotter"])
        rows.append((i, " ".join(own), "en", "s", 1))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_quality(spark):
    rows, labels = judged_rows()
    rows += [(900, None, "", "", 0), (901, "", "", "", 0), (None, "x", "", "", 0), (5, rows[5][1], "", "", 0)]
    df = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(1).alias(c) for c in CLASHES))
    marks = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    stats = quality.document_statistics(df)
    model = quality.fit(stats, marks.where("doc_id % 4 <> 1"))
    got = quality.score(stats, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.doc_id in truth and r.doc_id % 4 == 1]
    assert sum((r.score >= 0.7) == bool(truth[r.doc_id]) for r in held) >= 0.97 * len(held)
    blank = quality.fit(stats, marks.limit(0))
    assert {r.score for r in quality.score(stats, blank).collect()} == {0.5}
    assert quality.score(quality.document_statistics(df.limit(0)), model).count() == 0


def test_isotonic_never_falls():
    r = np.random.default_rng(0)
    counts = r.integers(0, 20, quality.BINS).astype(float)
    points, heights = quality.isotonic(counts, np.floor(counts * r.random(quality.BINS)))
    assert (np.diff(heights) > 0).all() and (np.diff(points) > 0).all()


def test_toxicity(spark):
    rows, labels = judged_rows()
    rows += [(900, None, "", "", 0), (901, "", "", "", 0), (None, "rotter", "", "", 0), (5, rows[5][1], "", "", 0)]
    df = spark.createDataFrame(rows, DOCS).select("*", *(F.lit(1).alias(c) for c in CLASHES))
    marks = spark.createDataFrame(labels + [(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(toxicity.labelled_sample(df, marks.where("doc_id % 4 <> 1"), "toxic"), label_col="toxic")
    got = toxicity.score(df, model)
    assert set(got.columns) == set(df.columns)
    got = got.collect()
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.doc_id in truth and r.doc_id % 4 == 1]
    assert len(got) == len(rows) and sum((r.score >= 0.3) == bool(truth[r.doc_id]) for r in held) >= 0.97 * len(held)
    blank = toxicity.fit(toxicity.labelled_sample(df, marks.limit(0), "toxic"), label_col="toxic")
    assert all(r.score < 0.3 for r in toxicity.score(df, blank).collect())


@pytest.mark.parametrize("ones", [599, 600])
def test_toxic_features_do_not_depend_on_size(spark, ones):
    rows = spark.range(5 * ones).selectExpr(f"int(id < {ones}) as label", "if(id < 12, array(7L, 42L), array(7L)) as x")
    assert toxicity.choose(rows, ones, 4 * ones).tolist() == [42]


def test_counterfactuals_shrink_identity_weights():
    assert toxicity.swapped("Women and men, gay") == "men and women, straight"
    rng = np.random.default_rng(0)
    x, y, c = [], [], []
    for i in range(400):
        toxic, group = i % 2, int(rng.random() < (0.8 if i % 2 else 0.2))
        x.append(np.array([2] * toxic + [group]))
        c.append(np.array([2] * toxic + [1 - group]))
        y.append(toxic if rng.random() < 0.9 else 1 - toxic)
    names = np.array([10, 20, 30])
    plain = toxicity.fit_rows(names, x, np.array(y, float), [None] * 400)
    fair = toxicity.fit_rows(names, x, np.array(y, float), c, counterfactual=50.0)
    gap = lambda m: abs(m.weights[1] - m.weights[0])
    assert gap(fair) < 0.5 * gap(plain) and fair.weights[2] > 1


def test_decontamination(spark):
    r = random.Random(8)
    items = {i: " ".join(words(r, r.randint(12, 40), 2000)) for i in range(25)} | {50: "two words", 51: "", 52: None, 53: "", 54: " ".join(["again"] * 12)}
    docs = {}
    for i in range(120):
        own = words(r, r.randint(1, 200), 2000)
        if i % 3 == 0:
            item = items[r.randrange(25)].split(" ")
            if i % 2:
                item[r.randrange(len(item))] = "edited"
            at = r.randrange(len(own) + 1)
            own[at:at] = [w.upper() + "," for w in item] if i % 5 == 0 else item
        docs[i] = " ".join(own)
    docs |= {200: None, 201: "", 202: "here two, Words there", 203: "again " * 30, 204: items[3]}
    marks = spark.createDataFrame(list(items.items()) + [(3, items[3])], "item_id bigint, text string").select("*", *(F.lit(1).alias(c) for c in CLASHES))
    df = frame(spark, docs, True)
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(df.unionByName(df.where("doc_id = 204")), marks).collect()}
    assert got == brute.leaks(docs, items)
    assert decontaminate.leaks(df.limit(0), marks).count() == 0 and decontaminate.leaks(df, marks.limit(0)).count() == 0


def test_decontamination_is_native(spark):
    df, marks = frame(spark, {1: "a b c d e f"}), spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    plan = decontaminate.leaks(df, marks)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_blocks_meet_within_radius(spark):
    r = random.Random(9)
    rows = []
    for _ in range(200):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), decontaminate.RADIUS):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    own = [decontaminate.blocks(F.col(c), decontaminate.RADIUS) for c in "ab"]
    assert df.where(F.arrays_overlap(*own)).count() == 200


def test_decontamination_of_shifted_and_edited_passages(spark, monkeypatch):
    """Words put in, taken out and replaced, at the edges of the similarity; documents in several segments; recall."""
    monkeypatch.setattr(decontaminate, "SEGMENT", 64)
    r = random.Random(21)
    items = {i: " ".join(words(r, r.randint(20, 40), 3000)) for i in range(12)}
    docs = {}
    for i in range(280):
        own = items[i % 12].split(" ")
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(own))
            own[at : at + r.randrange(2)] = ["edited"] * r.randrange(3)
        before, after = words(r, r.randint(0, 90), 3000), words(r, r.randint(0, 20), 3000)
        docs[i] = " ".join(before + own + after)
    docs[500] = " ".join(words(r, 300, 3000) + items[7].split(" ") + words(r, 300, 3000))
    marks = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(frame(spark, docs), marks).collect()}
    want = brute.leaks(docs, items)
    assert got <= want and len(got) >= 0.98 * len(want) and (500, 7) in got
    edge = want - brute.leaks(docs, items, similar=83)
    assert len(edge) >= 5 and len(edge & got) >= 0.9 * len(edge)


def test_decontamination_null_and_repeated_ids(spark):
    r = random.Random(22)
    passage, other = (" ".join(words(r, 30, 3000)) for _ in range(2))
    rows = [(None, f"a {passage}"), (None, f"b c {passage}"), (7, passage), (7, f"d {passage}"), (7, passage), (8, "x " * 50), (None, None), (9, other)]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], DOCS)
    marks = spark.createDataFrame([(None, passage), (None, other), (None, None)], "item_id bigint, text string")
    got = sorted((x.doc_id or 0, x.start) for x in decontaminate.leaks(docs, marks).collect())
    assert got == [(0, 1), (0, 2), (7, 0), (7, 1), (9, 0)]


def test_similar_sets_share_a_signature():
    """Sets of all sizes, at the edge of the similarity, some with most parts empty."""
    r = np.random.default_rng(5)
    for t in (60, 80, 90):
        levels, level_of = ngram_jaccard.Levels(t), []
        for n in [*range(2, 60), 200, 1000, 5000]:
            for _ in range(8):
                a = r.integers(1, 1 << 63, n, dtype=np.uint64)
                gone = int(r.integers(0, 1 + n * (100 - t) // 100))
                more = int(r.integers(0, 1 + n * (100 - t) // t))
                b = np.unique(np.concatenate([a[gone:], r.integers(1, 1 << 63, more, dtype=np.uint64)]))
                inter = len(np.intersect1d(a, b))
                if len(b) and 100 * inter >= t * (len(a) + len(b) - inter):
                    assert np.isin(levels.signatures(np.unique(a)), levels.signatures(b)).any()
                    level_of.append(abs(levels.of(len(a)) - levels.of(len(b))))
        assert max(level_of) == 1 and len(level_of) > 200


def test_different_words_are_different_sets(spark):
    a = "a"
    for _ in range(10):
        a += a.translate(str.maketrans("ab", "ba"))
    docs = {1: a, 2: a.translate(str.maketrans("ab", "ba")), 3: a.upper(), 4: " ".join([a] * 30), 5: " ".join([docs_word(i) for i in range(30)])}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.jaccard_groups(frame(spark, docs)).collect()}
    assert got == brute.groups(docs, 3, 90)


def docs_word(i):
    return f"w{i}"


def test_classes_that_share_half_a_key(spark, docs, monkeypatch):
    plain = ngram_jaccard.class_of
    monkeypatch.setattr(ngram_jaccard, "class_of", lambda tokens: (plain(tokens)[0] % 5, plain(tokens)[1]))
    own = {d: t for d, t in docs.items() if d > 40}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.jaccard_groups(frame(spark, own), 3, 90).collect()}
    assert got == brute.groups(own, 3, 90)


def test_a_token_in_very_many_small_sets(spark):
    """They are frequent, yet nothing links or pairs them."""
    n = 100_000
    rows = spark.range(n).selectExpr("id as doc_id", "concat('one two three ', array_join(transform(sequence(1, 12), i -> concat('w', id, 'x', i)), ' ')) as text")
    near = spark.createDataFrame([(n + i, "one two three " + " ".join(f"y{j}" for j in range(20 + i))) for i in range(3)], "doc_id bigint, text string")
    got = ngram_jaccard.jaccard_groups(rows.unionByName(near))
    found = got.where("n_links > 0 or component_id <> doc_id").collect()
    assert {(r.doc_id, r.component_id, r.n_links) for r in found} == {(n, n, 2), (n + 1, n, 2), (n + 2, n, 2)}


def test_clusters_of_many_blocks(spark, monkeypatch):
    """Near copies of many lengths, some in a chain of links, verified in pairs of blocks."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", 4)
    monkeypatch.setattr(ngram_jaccard, "PAIRED", 16)
    base = [f"w{i}" for i in range(200)]
    docs = {i: " ".join(base[: 60 + i]) for i in range(140)}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in ngram_jaccard.jaccard_groups(frame(spark, docs)).collect()}
    assert got == brute.groups(docs, 3, 90)


def test_encoder_of_every_tokenizer():
    """Word by word only where the file allows it; ids are those of the whole text by all files."""
    from pathlib import Path

    from tokenizers import Tokenizer

    r = random.Random(14)
    letters = "aB'sé \t\nİ\x1c\x85\xa0  字1.,!ßÉ́ÿ;|"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(200)] + ["The quick  brown fox. It's 12\n\nover"]
    by = {}
    for path in sorted(Path(TOKENIZER).parent.glob("*.json")):
        whole, own = Tokenizer.from_file(str(path)), tokens.Encoder(str(path), None)
        by[path.name] = own.words
        for text in texts:
            assert np.frombuffer(own.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert by["word_bpe_49k.json"] and not by["byte_bpe_50k.json"]


def test_line_dedup_of_many_equal_rows(spark):
    """Equal rows, with and without ids, have their spans once."""
    same = "a\nb\nc\nd\na\nb\nc\nz"
    rows = spark.createDataFrame([(5, same, "", "", 1)] * 300 + [(None, "q\nr\ns\nq\nr\ns", "", "", 1)] * 200, DOCS).withColumn("removed", F.lit("x"))
    got = line_dedup.dedup_lines(rows, into="spans")
    assert set(got.columns) == set(rows.columns) | {"spans"}
    assert {(r.doc_id, r.text, len(r.spans), r.removed) for r in got.collect()} == {(5, "a\nb\nc\nd\nz", 1, "x"), (None, "q\nr\ns", 1, "x")}


def test_below_is_a_binary_search(spark):
    for n in (0, 1, 2, 7, 8, 100):
        cuts = [f"{i:03}" for i in range(0, 2 * n, 2)]
        got = spark.range(2 * n + 2).select(F.format_string("%03d", "id").alias("at")).select("at", url_filter.below(cuts, F.col("at")).alias("k")).collect()
        assert all(r.k == sum(c <= r.at for c in cuts) for r in got)


def test_long_urls(spark):
    urls = ["http://example.org/es/" + "x" * 300_000, "http://" + "a." * 50_000 + "example.org/es/"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[0])], "page_id bigint, url string")
    assert {r.rule for r in url_filter.filter_urls(pages, RULES).collect()} == {"example.org/es/"}


LEFT_BY_TASKS = """
import random, re, sys
import pyarrow as pa
from waymark.llm import common, ngram_jaccard, tokens

def held():
    return sum(map(int, re.findall(r"\\nAnonymous: +(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

class Marks:
    value = bytes(1 << ngram_jaccard.SLOT_BITS - 3)

r = random.Random(2)
texts = [" ".join(f"w{r.randrange(50_000)}" for _ in range(400)) for _ in range(4000)]
def batches():
    for at in range(0, len(texts), 1000):
        yield pa.RecordBatch.from_pydict({"id": list(range(1000)), "text": pa.array(texts[at : at + 1000], pa.string())})
for _ in tokens.documents(batches(), sys.argv[1], 2, True, 1 << 18):
    pass
for _ in ngram_jaccard.prefixes(batches(), 5, 80, (1 << 64) - 1, 54, Marks, {}):
    pass
encoders = [k for k in sys.modules["waymark_worker"].__dict__ if k[0] == "encoder"]
before = held()
pa.default_memory_pool().release_unused()
__import__("ctypes").CDLL(None).malloc_trim(0)
print(len(encoders), round(before - held()))
"""


def test_what_tasks_leave_in_a_worker():
    """After a task a worker holds neither much freed memory nor what only other operators use."""
    import subprocess
    import sys
    from pathlib import Path

    done = subprocess.run([sys.executable, "-c", LEFT_BY_TASKS, TOKENIZER], cwd=Path(common.__file__).parents[2], capture_output=True, text=True, check=True)
    encoders, free_mb = map(int, done.stdout.split())
    assert encoders == 0 and free_mb < 16
